"""Fixture views, registered queries with their check SQL, and multi-step plans."""
from importlib import import_module
from pkgutil import iter_modules


def load_all() -> None:
    """Import every query module so that the registry is complete."""
    for module in iter_modules(__path__):
        if module.name.startswith("q_"):
            import_module(f"{__name__}.{module.name}")
