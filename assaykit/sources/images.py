"""Image folders as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.sources.labels import image_stem

EXTENSIONS = ("png", "jpg", "jpeg")


def list_images(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, recursive: bool = True) -> DataFrame:
    """(path, image_file, stem, length): matching files, any letter case; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    wanted = "(?i)\\.(" + "|".join(extensions) + ")$"
    return (
        files.select("path", "length")
        .filter(F.col("path").rlike(wanted))
        .withColumn("image_file", F.element_at(F.split("path", "/"), -1))
        .withColumn("stem", image_stem("path"))
    )


def any_case(extensions: tuple[str, ...] = EXTENSIONS) -> str:
    """A path glob for these extensions in any letter case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" for c in e) for e in extensions) + "}"


def to_gray(data: bytes, channels: int) -> bytes:
    """One byte per pixel from BGR or BGRA bytes; gray passes through."""
    if channels == 1:
        return data
    p = np.frombuffer(data, np.uint8).reshape(-1, channels).astype(np.uint32)
    # fixed values: the usual 16-bit weights of red, green and blue in luma, rounded
    return ((p[:, 2] * 19595 + p[:, 1] * 38470 + p[:, 0] * 7471 + 32768) >> 16).astype(np.uint8).tobytes()


def read_images(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(image_file, h, w, pixels, valid): every image as 8-bit gray, decoded by the JVM.

    Colour is converted; a file that can't be decoded stays as a row with ``valid`` false and
    no pixels, so that a caller can count or reject it.
    """

    @F.pandas_udf("binary")
    def gray(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([to_gray(bytes(d), c) if c > 0 else None for d, c in zip(data, channels)], dtype=object)

    img = spark.read.format("image").option("pathGlobFilter", glob or any_case()).option("dropInvalid", False).load(folder)
    valid = F.col("image.nChannels") > 0
    return img.select(
        F.element_at(F.split("image.origin", "/"), -1).alias("image_file"),
        F.when(valid, F.col("image.height")).alias("h"),
        F.when(valid, F.col("image.width")).alias("w"),
        gray("image.data", "image.nChannels").alias("pixels"),
        valid.alias("valid"),
    )
