"""Image-column operators: histograms, histogram matching, embedding.

An image is a row with an ``array<int>`` (or binary, one byte per pixel) column.
Per-image work runs on Arrow batches; only 256 counts per task are ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.fixed_values import GRAY_LEVELS
from assaykit.functions.vectors import l2_normalise


def _flat(column: pa.Array) -> np.ndarray:
    """All pixels of a batch; bytes stay bytes."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        parts = [np.frombuffer(v.as_py(), dtype=np.uint8) for v in column if v.is_valid]
        return np.concatenate(parts) if parts else np.empty(0, np.uint8)
    return column.flatten().to_numpy(zero_copy_only=False)


def _counted(values: np.ndarray, bins: int) -> np.ndarray:
    """Counts by gray level; a level outside of [0, bins) is an error, not a loss."""
    if len(values) and not 0 <= values.min() <= values.max() < bins:
        raise ValueError(f"pixel values must lie in [0, {bins})")
    return np.bincount(values, minlength=bins)


def histograms(images: DataFrame, pixels: str = "pixels", out: str = "hist", bins: int = GRAY_LEVELS) -> DataFrame:
    """Append the per-image histogram as array<bigint>; nothing is shuffled."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def count(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _counted(_as_pixels(v), bins))

    return images.withColumn(out, count(F.col(pixels)))


def _as_pixels(v: bytes | np.ndarray) -> np.ndarray:
    return np.frombuffer(v, dtype=np.uint8) if isinstance(v, (bytes, bytearray)) else np.asarray(v)


def histogram_rows(images: DataFrame, key: str, pixels: str = "pixels") -> DataFrame:
    """The same as (key, bin, n) rows, absent bins left out; for small images and SQL use."""
    return (
        images.select(key, F.explode(pixels).alias("bin")).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))
    )


def aggregate_histogram(images: DataFrame, pixels: str = "pixels", bins: int = GRAY_LEVELS) -> DataFrame:
    """(bin, total, n_images, mean): the average histogram, all bins present.

    Each task sums its own images, so ``bins`` rows per task meet in the shuffle.
    """
    schema = "bin int, total long, images long"
    arrow = pa.schema([("bin", pa.int32()), ("total", pa.int64()), ("images", pa.int64())])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(bins, np.int64), 0
        for b in batches:
            total += _counted(_flat(b.column(0)), bins)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(bins, dtype=np.int32)), pa.array(total), pa.array(np.full(bins, n))], schema=arrow
        )

    return (
        images.select(pixels)
        .mapInArrow(add_up, schema)
        .groupBy("bin")
        .agg(F.sum("total").alias("total"), F.sum("images").alias("n_images"))
        .withColumn("mean", F.col("total") / F.col("n_images"))
    )


def reference_levels(reference: DataFrame, pixels: str = "pixels", bins: int = GRAY_LEVELS) -> list[int]:
    """The reference histogram as ``bins`` totals on the driver (a fixed, tiny size).

    Totals serve as well as means: the matching only looks at their cumulative share.
    """
    rows = aggregate_histogram(reference, pixels, bins).collect()
    totals = dict((r["bin"], r["total"]) for r in rows)
    if not any(totals.values()):
        raise ValueError("the reference holds no pixels")
    return [totals.get(i, 0) for i in range(bins)]


def lookup_table(hist: np.ndarray, reference: np.ndarray, occurring: bool = False) -> np.ndarray:
    """Gray level -> matched gray level: the image's cumulative share, read off the reference curve.

    The curve has a knot at every level, or with ``occurring`` only at levels that the reference holds:
    the first suits an average over many images, the second matching to one image. Values between knots are
    interpolated and cut to integers.
    """
    levels = np.flatnonzero(reference) if occurring else np.arange(len(reference))
    curve = np.cumsum(reference)[levels] / np.sum(reference)
    return np.interp(np.cumsum(hist) / np.sum(hist), curve, levels).astype(np.int32)


def match_histogram(
    images: DataFrame, levels: Sequence[int], pixels: str = "pixels", out: str = "matched", occurring: bool = False
) -> DataFrame:
    """Remap every image so that its histogram follows the reference levels."""
    bins = len(levels)
    counts = np.asarray(levels, dtype=np.int64)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def remap(values: pd.Series) -> pd.Series:
        def one(v):
            p = _as_pixels(v)
            if len(p) == 0:
                return p.astype(np.int32)
            return lookup_table(_counted(p, bins), counts, occurring)[p]

        return values.map(one)

    return images.withColumn(out, remap(F.col(pixels)))


def harmonise(pool: DataFrame, reference: DataFrame, pixels: str = "pixels", out: str = "matched") -> DataFrame:
    """Match a pool to the average histogram of the reference images."""
    return match_histogram(pool, reference_levels(reference, pixels), pixels, out)


def match_image(pool: DataFrame, reference: DataFrame, pixels: str = "pixels", out: str = "matched") -> DataFrame:
    """Match a pool to one reference image: only gray levels that it holds are given out."""
    return match_histogram(pool, reference_levels(reference, pixels), pixels, out, occurring=True)


def embed(images: DataFrame, encoder: Column | Callable[[Column], Column], content: str = "pixels", out: str = "embedding") -> DataFrame:
    """Append a unit-length embedding from a user-supplied encoder.

    ``encoder`` is a Column function, typically ``predict_batch_udf(make_predict_fn, …)``,
    whose model is loaded once per Python worker.
    """
    raw = encoder(F.col(content)) if callable(encoder) else encoder
    return images.withColumn("__raw", raw).withColumn(out, l2_normalise(F.col("__raw"))).drop("__raw")


def batch_encoder(make_predict_fn: Callable, batch_size: int = 16, input_shape: Sequence[int] | None = None) -> Callable[[Column], Column]:
    """Wrap a batch prediction function (numpy in, numpy out) as an encoder column."""
    from pyspark.ml.functions import predict_batch_udf

    options = {"input_tensor_shapes": [list(input_shape)]} if input_shape else {}
    return predict_batch_udf(
        make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, **options
    )
