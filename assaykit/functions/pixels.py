"""Pixel-array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit import fixed_values as V


def window_level(pixels: Column, level: float = V.WINDOW_LEVEL, width: float = V.WINDOW_WIDTH) -> Column:
    """Map raw intensities to 0..255 through a window, clipping and truncating."""
    low, high = level - width / 2.0, level + width / 2.0
    scale = 255.0 / (high - low)

    def one(x: Column) -> Column:
        y = (x.cast("double") - F.lit(low)) * F.lit(scale)
        return F.floor(F.least(F.greatest(y, F.lit(0.0)), F.lit(255.0))).cast("int")

    return F.transform(pixels, one)


def apply_lookup(pixels: Column, lookup: Column) -> Column:
    return F.transform(pixels, lambda p: F.get(lookup, p))
