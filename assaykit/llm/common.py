"""Column helpers and stored intermediates shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Hashable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs, retries and lost
    executors start from the files, not from the plan that made them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_REMEMBERED: dict[Hashable, object] = {}


def remembered[T](owner: Hashable, make: Callable[[], T]) -> T:
    """What an operator remembers in a Python worker from task to task.

    Workers outlive the operators of a job; a worker remembers things of one owner at a time and
    gives up those of the owner before.
    """
    if owner not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[owner] = make()
    return _REMEMBERED[owner]


def release() -> None:
    """Give free memory of this Python worker back to the system, Arrow's and that of numpy and other C code."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def released(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task, whose worker then keeps no free memory: it may wait through stages of the JVM alone."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        release()

    return run


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on ``key`` where one key may hold much of ``left`` and ``right`` comes from an aggregation by it.

    The second key makes Spark deal out the aggregated side anew, so that both sides of the join are
    plain shuffles, which adaptive execution can split where a key is hot.
    """
    weight = F.length(F.col(key).cast("string"))
    return left.withColumn("__w", weight).join(right.withColumn("__w", weight), [key, "__w"], how).drop("__w")


def crc32_sql(value: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a value's ASCII text, bit by bit; null stays null."""
    codes = f"list_transform(string_split({value}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    shift = "lambda r, z: xor(r >> 1, (r & 1) * 3988292384::BIGINT)"
    byte = f"lambda a, c: list_reduce(list_prepend(xor(a, c), list_resize([]::BIGINT[], 8, 0)), {shift})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), {byte}), 4294967295::BIGINT)"
