"""Global order without a global sort task.

A window without a partition puts every row in one task. Here the order key starts
with a hash bucket: rows are numbered inside their bucket, and a table of at most
4096 bucket totals per group supplies the offsets. Buckets are hashes of unique
keys, so they are even whatever the data looks like.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions.keyed import hash_bucket, key_hash


def with_hash_order(df: DataFrame, seed: int | str, keys: Sequence[str], h: str = "__h", bucket: str = "__bucket") -> DataFrame:
    return df.withColumn(h, key_hash(seed, *keys)).withColumn(bucket, hash_bucket(F.col(h)))


def dense_index(
    df: DataFrame, seed: int | str, keys: Sequence[str], within: Sequence[str] = (), out: str = "idx"
) -> DataFrame:
    """Append the zero-based position of each row in keyed-hash order (per ``within`` group).

    A hot group is spread over its buckets; no task ever holds a whole group.
    """
    within = list(within)
    hashed = with_hash_order(df, seed, keys)
    totals = hashed.groupBy(*within, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(*within, "__bucket", (F.sum("__n").over(before) - F.col("__n")).alias("__offset"))
    inside = Window.partitionBy(*within, "__bucket").orderBy("__h", *keys)
    return (
        hashed.join(offsets, [*within, "__bucket"])
        .withColumn(out, F.col("__offset") + F.row_number().over(inside) - F.lit(1))
        .drop("__h", "__bucket", "__offset")
    )


def take_by_hash(
    df: DataFrame,
    quotas: DataFrame | Callable[[DataFrame], DataFrame],
    strata: Sequence[str],
    keys: Sequence[str],
    seed: int | str,
    quota: str = "quota",
    max_strata: int | None = None,
) -> DataFrame:
    """The ``quota`` rows with the smallest keyed hash of every stratum, exactly.

    1. rows are counted per (stratum, bucket) — at most 4096 rows per stratum;
    2. a running total finds the bucket where the quota is reached;
    3. rows in lower buckets are taken, rows in that bucket are ranked.

    ``quotas`` is a table (strata, quota) or a function from the table of stratum counts
    (strata, n) to it; the function form reads the input once less. Only sampled rows
    are shuffled. The cut table has one row per stratum and is broadcast when
    ``max_strata`` proves it small.
    """
    strata = list(strata)
    hashed = with_hash_order(df, seed, keys)
    totals = hashed.groupBy(*strata, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    if callable(quotas):
        quotas = quotas(totals.groupBy(*strata).agg(F.sum("__n").alias("n")))
    upto = Window.partitionBy(*strata).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = (
        totals.join(quotas.select(*strata, F.col(quota).alias("__quota")), strata)
        .withColumn("__upto", F.sum("__n").over(upto))
        .filter(F.col("__quota") > 0)
        .groupBy(*strata)
        .agg(
            # the first bucket in which the quota is met; none means the whole stratum is taken
            F.min(F.when(F.col("__upto") >= F.col("__quota"), F.col("__bucket"))).alias("__cut"),
            F.max(F.when(F.col("__upto") < F.col("__quota"), F.col("__upto"))).alias("__full"),
            F.first("__quota").alias("__quota"),
        )
        .withColumn("__rest", F.col("__quota") - F.coalesce(F.col("__full"), F.lit(0)))
        .select(*strata, "__cut", "__rest")
    )
    if max_strata is not None and max_strata <= 4096:
        cut = F.broadcast(cut)
    near = hashed.join(cut, strata).filter(F.col("__cut").isNull() | (F.col("__bucket") <= F.col("__cut")))
    inside = Window.partitionBy(*strata, "__bucket").orderBy("__h", *keys)
    return (
        near.withColumn("__rank", F.row_number().over(inside))
        .filter(F.col("__cut").isNull() | (F.col("__bucket") < F.col("__cut")) | (F.col("__rank") <= F.col("__rest")))
        .select(*df.columns)
    )


def smallest_by_hash(df: DataFrame, n: int, keys: Sequence[str], seed: int | str) -> DataFrame:
    """The ``n`` rows with the smallest keyed hash: ``take_by_hash`` for one stratum.

    The cut is a scalar, so nothing is joined; a global sort or limit task is not needed
    either, whatever ``n``.
    """
    hashed = with_hash_order(df, seed, keys)
    upto = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # bucket totals only
    cut = (
        hashed.groupBy("__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__upto", F.sum("__n").over(upto))
        .agg(
            F.struct(
                F.min(F.when(F.col("__upto") >= n, F.col("__bucket"))).alias("bucket"),
                (F.lit(n) - F.coalesce(F.max(F.when(F.col("__upto") < n, F.col("__upto"))), F.lit(0))).alias("rest"),
            ).alias("cut")
        )
        .scalar()
    )
    inside = Window.partitionBy("__bucket").orderBy("__h", *keys)
    return (
        hashed.filter(F.coalesce(F.col("__bucket") <= cut["bucket"], F.lit(True)))
        .withColumn("__rank", F.row_number().over(inside))
        .filter(F.coalesce((F.col("__bucket") < cut["bucket"]) | (F.col("__rank") <= cut["rest"]), F.lit(True)))
        .select(*df.columns)
    )
