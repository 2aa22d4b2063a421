"""Compare registered queries with their SQL twins: ``python tests/check_queries.py [names…]``."""

import os
import sys
import tempfile
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def canonical(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pd.api.types.is_float_dtype(pdf[c]):
            pdf[c] = pdf[c].round(5) + 0.0
    rows = [tuple("null" if pd.isna(v) else (f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r) for r in pdf.itertuples(index=False)]
    return sorted(rows)


def kinds(pdf):
    return {c: pdf[c].dtype.kind for c in sorted(pdf.columns)}


def compare(spark, con, name, fn, sql, sf_dir):
    made = fn(spark, sf_dir)
    plan = made._jdf.queryExecution().executedPlan().toString()
    got = made.toPandas()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if bad in plan:
            return len(got), f"the plan has a {bad}"
    if sql is None:
        return len(got), None
    want = con.sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return len(got), f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return len(got), f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return len(got), f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}"
    if kinds(got) != kinds(want) and len(got):
        return len(got), f"kinds {kinds(got)} != {kinds(want)}"
    return len(got), ""


def force_split():
    """Small bounds, so that small tables take the paths of large ones."""
    from tidemark.operators import ordered, quantiles

    ordered.PLAIN_ROWS, ordered.BUCKET_ROWS, ordered.BLOCK_ROWS = 0, 100, 64
    quantiles.GROUP_CELLS, quantiles.SKETCH = 8, 200


def main():
    import __spark_entry__ as entry
    from tidemark.session import get_session

    if os.environ.get("CHECK_SPLIT"):
        force_split()
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = get_session("check", "local[8]", **{"spark__sql__shuffle__partitions": "8", "spark__ui__enabled": "false", "spark__driver__memory": "12g", "spark__checkpoint__dir": tempfile.mkdtemp(prefix="tidemark-check-")})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = sys.argv[1:] or list(entry.queries())
    oracles = entry.oracle_sql()
    failed = 0
    for name in names:
        begin = time.time()
        try:
            n, problem = compare(spark, con, name, entry.queries()[name], oracles.get(name), sf_dir)
        except Exception as e:  # report and go on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        took = time.time() - begin
        state = "rows-only" if problem is None else ("ok" if problem == "" else "FAIL " + problem)
        failed += bool(problem) or n <= 0
        print(f"{name:34s} {took:6.1f}s {n:8d} {state}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
