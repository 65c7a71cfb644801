"""Positions of pattern matches with SQL functions only.

The JVM's split and regexp_extract_all walk the same leftmost, non-overlapping matches, so the gaps
of the one and the matches of the other alternate; running lengths give the positions in code points.
Lengths are added up in chunks of 256 matches, so texts with very many matches stay near linear.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 256


def _sum(of: str) -> str:
    return f"aggregate({of}, 0L, (s, x) -> s + x)"


def with_matches(df: DataFrame, patterns: dict[str, tuple[str, int]], text: str = "text",
                 context: int = 0) -> DataFrame:
    """Add one array of (start, end, match, part) per entry name → (pattern, group of the part).

    With `context`, also (before, after): that many characters on either side, up to the next match.
    Patterns must not match the empty string. Rows without a match, and null texts, get empty arrays.
    """
    plain = [F.col(f"`{c}`") for c in df.columns]

    def when_found(pattern: str, value: Column, empty: str) -> Column:
        return F.when(F.col(text).rlike(pattern), value).otherwise(F.expr(empty))

    none = "cast(array() as array<string>)"
    raw = []
    for name, (pattern, group) in patterns.items():
        raw.append(when_found(pattern, F.split(text, pattern, -1), none).alias(f"_gap_{name}"))
        raw.append(when_found(pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), none)
                   .alias(f"_hit_{name}"))
        if group:
            raw.append(when_found(pattern, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), none)
                       .alias(f"_part_{name}"))
    # each step is a projection of its own: inside a lambda a nested expression would run per element
    df = df.select(*plain, *raw)
    lengths = []
    for name, (_, group) in patterns.items():
        lengths += [F.expr(f"transform(_gap_{name}, x -> cast(char_length(x) as bigint))").alias(f"_g_{name}"),
                    F.expr(f"transform(_hit_{name}, x -> cast(char_length(x) as bigint))").alias(f"_h_{name}"),
                    F.col(f"_gap_{name}"), F.col(f"_hit_{name}"), F.col(f"_part_{name}" if group else f"_hit_{name}").alias(f"_p_{name}")]
    df = df.select(*plain, *lengths)
    chunked = []
    for name in patterns:
        g, h = f"_g_{name}", f"_h_{name}"
        chunk = f"slice({{}}, c * {_CHUNK} + 1, {_CHUNK})"
        chunked.append(F.expr(
            f"transform(sequence(0, size({h}) div {_CHUNK}), c -> "
            f"{_sum(chunk.format(g))} + {_sum(chunk.format(h))})").alias(f"_c_{name}"))
    df = df.select(*plain, *(F.col(f"{k}_{name}") for name in patterns for k in ("_g", "_h", "_gap", "_hit", "_p")), *chunked)
    out = []
    for name in patterns:
        g, h, c = f"_g_{name}", f"_h_{name}", f"_c_{name}"
        base = f"(i div {_CHUNK}) * {_CHUNK}"
        start = (f"{_sum(f'slice({c}, 1, cast(i div {_CHUNK} as int))')} + "
                 f"{_sum(f'slice({g}, cast({base} as int) + 1, cast(i - {base} as int) + 1)')} + "
                 f"{_sum(f'slice({h}, cast({base} as int) + 1, cast(i - {base} as int))')}")
        around = (f", 'before', right(_gap_{name}[x.i], {context}), 'after', left(_gap_{name}[x.i + 1], {context})"
                  if context else "")
        # the length is added in a second pass, so that start is worked out once
        out.append(F.expr(
            f"transform(transform({h}, (n, i) -> struct({start} as start, n as n, i as i)), x -> "
            f"named_struct('start', x.start, 'end', x.start + x.n, 'match', _hit_{name}[x.i], "
            f"'part', _p_{name}[x.i]{around}))").alias(name))
    return df.select(*plain, *out)
