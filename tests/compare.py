"""Run registered queries next to their SQL and compare values.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
TIMES: dict[str, float] = {}


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(spark, con, sf_dir, name, query, sql):
    start = time.time()
    frame = query(spark, sf_dir)
    got = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    TIMES[name] = time.time() - start
    result = con.execute(sql)
    want = canonical([d[0] for d in result.description], result.fetchall())
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in result.description}
    wrong = {c: (t, types.get(c)) for c, t in frame.dtypes if types.get(c) != t}
    if wrong:
        return f"types differ: {wrong}"
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows != {len(want[1])}"
    differing = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(differing)} rows differ, first {differing[0]}" if differing else None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in wanted:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} spark {TIMES.get(name, 0):.1f}s total {time.time() - start:.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
