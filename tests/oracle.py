"""Runs registered queries next to their SQL and compares names, row counts and values.

    python tests/oracle.py [sf dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _text(value) -> str:
    if value is None or (isinstance(value, float) and pd.isna(value)) or value is pd.NA:
        return "null"
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def canonical(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(frame.columns)
    return sorted(tuple(_text(v) for v in row) for row in frame[columns].itertuples(index=False))


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """What differs, or None where names, row count and every value agree."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} rows against {len(sql_frame)}"
    a, b = canonical(spark_frame), canonical(sql_frame)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(wrong)} rows differ, first {wrong[0]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from helioquant.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(sf_dir)
    oracle = entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            seconds = time.time() - start
            if name not in oracle:
                print(f"rows  {name}: {len(got)} ({seconds:.2f} s)", flush=True)
                continue
            problem = difference(got, con.execute(oracle[name]).df())
        except Exception as exc:  # noqa: BLE001
            problem, seconds, got = str(exc)[:1500], time.time() - start, []
        failed += problem is not None
        print(f"{'ok   ' if problem is None else 'FAIL '} {name}: {len(got)} rows ({seconds:.2f} s) {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
