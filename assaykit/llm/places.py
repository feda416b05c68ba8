"""Places of rows inside ordered groups, and running sums along them, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import stored

_FEWER = Window.unboundedPreceding


def placed(rows: DataFrame, group: str, order: list[Column], what: str) -> DataFrame:
    """``rows`` with ``pos``, the place from 0 inside the row's group, and ``n``, the group's size.

    ``rows`` should be stored, as they are read twice: ranges of (group, order) are sampled, then dealt out and
    sorted. A group may lie in many ranges; the counts of (range, group) give each range its start. The order
    must leave no ties, or rows with one place would be told apart by chance. ``group`` must not be null.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    at = F.monotonically_increasing_id()
    dealt = stored(dealt.withColumn("__range", F.shiftright(at, 33)).withColumn("__at", at), what)
    parts = dealt.groupBy("__range", group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(own.orderBy("__range").rowsBetween(_FEWER, -1)), F.lit(0))
    starts = parts.select("__range", group, (before - F.col("__first")).alias("__shift"), F.sum("__n").over(own).alias("n"))
    joined = dealt.join(starts, ["__range", group])
    return joined.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__range", "__at", "__shift")


def running(rows: DataFrame, group: str, stretch: Column, order: Column, values: list[str]) -> DataFrame:
    """Each of ``values`` becomes its sum over the group's rows up to this one, in ``order``.

    ``stretch`` ascends with ``order`` and holds few rows; stretches are summed first, so a group of any size is
    only ever one task in the table of its stretches.
    """
    cut = rows.withColumn("__stretch", stretch).withColumn("__order", order)
    totals = cut.groupBy(group, "__stretch").agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(group).orderBy("__stretch").rowsBetween(_FEWER, -1)
    before = totals.select(group, "__stretch", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy(group, "__stretch").orderBy("__order").rowsBetween(_FEWER, 0)
    sums = {v: F.sum(v).over(inside) + F.col(f"__{v}") for v in values}
    return cut.join(before, [group, "__stretch"]).withColumns(sums).drop("__stretch", "__order", *[f"__{v}" for v in values])
