"""Key uniqueness: one row per key, or a loud failure.

Built on groupBy with mergeable aggregates, not on windows, so a key that holds a
third of all rows is folded on the map side and never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_by(df: DataFrame, keys: str | Sequence[str], how: str = "error", order: str | Column | None = None) -> DataFrame:
    """``error`` raises on the first duplicate key, ``last`` keeps the row with the
    greatest ``order``, ``keep`` leaves the rows as they are."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if how == "keep":
        return df
    if how == "error":
        # only the keys are shuffled; the rows pass through once the check has come out clean
        twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
        example = twice.agg(F.min(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])).alias("k")).scalar()
        message = F.concat(F.lit(f"duplicate key in {keys}: "), example)
        return df.filter(F.when(example.isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    if how == "last":
        if order is None:
            raise ValueError("how='last' needs an order column")
        row = F.struct(*[c for c in df.columns if c not in keys])
        by = order if isinstance(order, Column) else F.col(order)
        # a null has no place in an order: it would lose its row without a sign
        by = F.coalesce(by, F.raise_error(F.lit(f"null order value for keys {keys}")).cast(df.select(by).schema[0].dataType))
        folded = df.groupBy(*keys).agg(F.max_by(row, by).alias("__row"))
        return folded.select(*[F.col(c) if c in keys else F.col("__row")[c].alias(c) for c in df.columns])
    raise ValueError(f"unknown duplicate policy: {how!r}")
