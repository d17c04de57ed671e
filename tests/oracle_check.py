"""Compare registered queries with their oracles: ``python tests/oracle_check.py [sf] [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    types = [str(table.schema.field(n).type).replace("large_", "") for n in names]
    columns = [table.column(n).to_pylist() for n in names]

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v

    rows = sorted((tuple(value(v) for v in row) for row in zip(*columns)), key=repr)
    return [f"{n}:{t}" for n, t in zip(names, types)], rows


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    got_schema, got = _plain(queries()[name](spark, sf_dir).toArrow())
    took = time.time() - start
    start = time.time()
    want_schema, want = _plain(con.execute(oracle_sql()[name]).to_arrow_table())
    other = time.time() - start
    note = f"{len(got)} rows, spark {took:.1f}s, duckdb {other:.1f}s"
    if got_schema != want_schema:
        return False, f"schema {got_schema} vs {want_schema}"
    if got != want:
        left = set(map(repr, got)) - set(map(repr, want))
        right = set(map(repr, want)) - set(map(repr, got))
        sample = f"\n  spark only: {sorted(left)[:2]}\n  duckdb only: {sorted(right)[:2]}"
        return False, f"{len(got)} vs {len(want)} rows, {len(left)}/{len(right)} differ{sample}"
    return True, note


def main() -> None:
    from tests.session import make_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    names = sys.argv[2:] or list(queries())
    spark = make_session()
    con = connect(sf_dir)
    bad = 0
    for name in names:
        if name not in oracle_sql():
            print(f"--   {name}: {queries()[name](spark, sf_dir).count()} rows, no oracle")
            continue
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
