"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(v: Column) -> Column:
    """Unit-length copy as array<float>; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(
        v.cast("array<float>")
    )
