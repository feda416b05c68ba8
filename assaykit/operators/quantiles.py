"""Exact order statistics per group, without a group ever being in one task.

``percentile`` keeps all distinct values of a group in one task. Here a group is narrowed down: its range is cut into
BUCKETS of equal width, rows are counted per bucket (folded on the map side), and only the bucket that holds the wanted rank
is looked at again, between its own least and greatest value. A bucket of at most FEW rows, or of one value, is the end. Values
spread evenly take one round for sixteen million rows; each round shrinks a skewed range to one bucket of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.session import cut_lineage

BUCKETS, FEW = 4096, 4096


def exact_quantile(df: DataFrame, by: Sequence[str], value: str, q: float = 0.5, out: str = "quantile", few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(by…, out): the ``q`` quantile of each group by linear interpolation, as ``percentile`` gives it.

    Null and NaN values don't count; a group without others has no row. Null is a group of its own.
    """
    by = list(by)
    group = F.to_json(F.struct(*by)) if by else F.lit("")  # null-safe as one text
    v = F.col(value).cast("double")
    rows = df.select(group.alias("__g"), v.alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    place = (F.count("*") - 1) * F.lit(q)
    # both ranks around the place, from 0; often one and the same
    sized = rows.groupBy("__g").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("*").alias("held"), place.alias("place"))
    ranks = F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("rank")
    open_ = cut_lineage(sized.select("__g", "lo", "hi", "held", ranks, F.lit(0).cast("long").alias("below")))

    while not open_.where((F.col("held") > few) & (F.col("lo") < F.col("hi"))).isEmpty():
        wide = (F.col("held") > few) & (F.col("lo") < F.col("hi"))
        inside = rows.join(open_.where(wide), "__g").where(F.col("__v").between(F.col("lo"), F.col("hi")))
        # halves before the difference, so that the width of the whole range of doubles is still a number
        part = (F.col("__v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counts = inside.groupBy("__g", "rank", "below", F.least(F.lit(buckets - 1), F.floor(part * buckets)).alias("bucket")).agg(
            F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi")
        )
        upto = Window.partitionBy("__g", "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
        before = counts.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(upto), F.lit(0)))
        hit = before.where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        narrowed = hit.select("__g", "lo", "hi", F.col("n").alias("held"), "rank", "below")
        open_ = cut_lineage(open_.where(~wide).unionByName(narrowed))

    alike = open_.where(F.col("lo") == F.col("hi")).select("__g", "rank", F.col("lo").alias("x"))
    near = rows.join(open_.where(F.col("lo") < F.col("hi")), "__g").where(F.col("__v").between(F.col("lo"), F.col("hi")))
    order = Window.partitionBy("__g", "rank").orderBy("__v")  # at most ``few`` rows
    ranked = near.withColumn("__r", F.col("below") + F.row_number().over(order) - 1).where(F.col("__r") == F.col("rank"))
    found = alike.unionByName(ranked.select("__g", "rank", F.col("__v").alias("x")))
    ends = found.groupBy("__g").agg(F.min_by("x", "rank").alias("a"), F.max_by("x", "rank").alias("b"), F.min("rank").alias("k"))
    value_at = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("place") - F.col("k")))
    done = ends.join(sized.select("__g", "place"), "__g").select("__g", value_at.alias(out))
    names = df.select(*by, group.alias("__g")).distinct() if by else done.select("__g")
    return done.join(names, "__g").select(*by, out)
