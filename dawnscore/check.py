"""Compare registered queries with their check SQL in DuckDB: python -m dawnscore.check [prefix ...]."""
from __future__ import annotations

import glob
import logging
import math
import os
import sys
import time


def connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        table = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canon(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def compare(spark, con, name: str, build, sql: str | None, sf_dir: str) -> tuple[str, int, str]:
    df = build(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_canon(v) for v in row) for row in df.select(*cols).collect())
    if sql is None:
        return ("rows-only", len(got), "")
    con.execute(sql)
    heads = [d[0] for d in con.description]
    if sorted(heads) != cols:
        return ("BAD", len(got), f"columns {cols} vs {sorted(heads)}")
    order = [heads.index(c) for c in cols]
    want = sorted(tuple(_canon(row[i]) for i in order) for row in con.fetchall())
    if got == want:
        return ("ok", len(got), "")
    diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
    return ("BAD", len(got), f"{cols}\n  rows {len(got)} vs {len(want)}; first differences "
            + "\n    ".join(map(str, diff)))


def main(argv: list[str]) -> int:
    from dawnscore.plans import load_all
    from dawnscore.plans.registry import ORACLE, QUERIES
    from dawnscore.session import local_session
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    load_all()
    spark, con = local_session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("OFF")
    logging.disable(logging.CRITICAL)
    bad = 0
    for name in sorted(QUERIES):
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        try:
            state, rows, note = compare(spark, con, name, QUERIES[name], ORACLE.get(name), sf_dir)
        except Exception as e:  # report and go on with the rest
            state, rows, note = "ERROR", -1, str(e)[:600]
        took = time.time() - t0
        if state not in ("ok", "rows-only") or rows == 0 or took > 6 or os.environ.get("VERBOSE"):
            print(f"{state:9} {name} rows={rows} {took:.1f}s {note}", flush=True)
        bad += state not in ("ok", "rows-only")
    print("bad:", bad, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1:])))
