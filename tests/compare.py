"""Run registered queries against DuckDB on the same files.

    python -m tests.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, float):
        return (0, "") if math.isnan(v) else (1, round(v, 6) + 0.0)
    if isinstance(v, int):
        return (1, v)
    try:
        return (1, round(float(v), 6)) if type(v).__name__ == "Decimal" else (2, str(v))
    except ValueError:
        return (2, str(v))


def _table(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if equal, else what differs."""
    mine = _table(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = _table(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if mine == theirs:
        return None
    return (
        f"{len(mine)} rows != {len(theirs)} rows; {sorted(names)}\n"
        f"   only Spark: {[r for r in mine if r not in set(theirs)][:3]}\n   only SQL: {[r for r in theirs if r not in set(mine)][:3]}"
    )


def main() -> None:
    import __spark_entry__ as entry

    from assaykit.session import builder

    sf, names = sys.argv[1], sys.argv[2:]
    spark = (
        builder(master="local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(sf), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if names and not any(n in name for n in names):
            continue
        begun = time.perf_counter()
        try:
            df = fn(spark, sf)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                note = "" if problem is None else "DIFF " + problem
            else:
                note = f"(no SQL) {len(df.collect())} rows"
                problem = None
        except Exception as e:  # noqa: BLE001
            problem = note = f"ERROR {type(e).__name__}: {str(e)[:1500]}"
            if "--trace" in sys.argv:
                traceback.print_exc()
        if problem:
            bad.append(name)
        print(f"{'ok ' if not problem else 'BAD'} {name:34} {time.perf_counter() - begun:6.2f}s {note}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
