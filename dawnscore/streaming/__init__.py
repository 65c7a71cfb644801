"""No streaming operator of its own: the row-wise ones run on a streaming DataFrame unchanged.

Operators whose inputs are columns of one row (functions.scalar, the linear, max, confidence,
agreement and pull blends, the levers and gates that are column expressions, tri_state_mask,
apply_detector) keep no state. Everything that ranks, smooths or aggregates other rows is batch
work over finished files. tests/test_streaming.py runs such a projection through a stream.
"""
