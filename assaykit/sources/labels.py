"""Label files, manifests and listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit import schemas
from assaykit.fixed_values import LONG_SUFFIXES, WIDE_COLUMNS
from assaykit.functions.labels import any_flag, present_text
from assaykit.operators.keys import unique_by


def read_named_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV columns by header name, whatever their order; a column a file lacks is null.

    Files are read in groups of equal headers, so files of one folder may order their columns
    differently. Only the header lines are read ahead; nothing is inferred. The driver holds the names of the files.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")
    )
    first = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    groups = first.groupBy("header").agg(F.collect_list("file").alias("files")).orderBy("header").collect()
    parts = [spark.read.csv(g.files, header=True) for g in groups] or [spark.createDataFrame([], schema)]
    out = None
    for raw in parts:
        names = {c.removeprefix("\ufeff"): c for c in raw.columns}
        part = raw.select(
            *[
                (F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in schema
            ]
        )
        out = part if out is None else out.unionByName(part)
    return out


def wide_labels(raw: DataFrame, columns: Mapping[str, str] = WIDE_COLUMNS) -> DataFrame:
    """Per-slice index: a row is normal only if marked so and no label fired."""
    flags = raw.select(
        F.col("PatientNumber").cast("int").alias("patient"),
        F.col("SliceNumber").cast("int").alias("slice"),
        *[F.col(c).cast("int").alias(k) for c, k in columns.items()],
        F.coalesce(F.col("Fracture_Yes_No").cast("int"), F.lit(0)).alias("Fracture"),
        F.coalesce(F.col("No_Hemorrhage").cast("int"), F.lit(0)).alias("No_Hemorrhage"),
    )
    keys = list(columns.values())
    return (
        flags.withColumn("any_hemorrhage", any_flag(keys))
        .withColumn("is_normal", (F.col("No_Hemorrhage") == 1) & (F.col("any_hemorrhage") == 0))
        .withColumn("present_subtypes", present_text(keys))
    )


def read_wide_labels(spark: SparkSession, path: str) -> DataFrame:
    """Wide CSV with cells such as ``0`` or ``1.0`` and perhaps a byte-order mark."""
    return wide_labels(read_named_csv(spark, path, schemas.WIDE_LABELS))


def long_labels(raw: DataFrame, suffixes: Mapping[str, str] = LONG_SUFFIXES, duplicates: str = "error") -> DataFrame:
    """One row per image from (``<image>_<label>``, Label) rows.

    The id is split at its last underscore; a missing label is 0; other suffixes (the
    file's own "any") are ignored. One aggregation with the label values given, so no
    pass is spent on finding them. Conflicting labels for one id raise, or with
    ``duplicates='keep'`` the larger one counts.
    """
    if duplicates not in ("error", "keep"):
        raise ValueError(f"unknown duplicate policy: {duplicates!r}")
    split = raw.select(
        F.regexp_extract("ID", r"(?s)^(.*)_([^_]*)$", 1).alias("image_id"),
        F.regexp_extract("ID", r"(?s)^(.*)_([^_]*)$", 2).alias("__suffix"),
        F.col("Label"),
    )

    def flag(suffix: str) -> Column:
        label = F.when(F.col("__suffix") == suffix, F.col("Label"))
        if duplicates == "keep":
            return F.coalesce(F.max(label), F.lit(0))
        clash = F.raise_error(F.concat(F.lit(f"conflicting {suffix} labels for "), F.col("image_id"))).cast("int")
        return F.coalesce(F.when(F.max(label) != F.min(label), clash).otherwise(F.max(label)), F.lit(0))

    keys = list(suffixes.values())
    return (
        split.groupBy("image_id")
        .agg(*[flag(s).cast("int").alias(k) for s, k in suffixes.items()])
        .withColumn("any_hemorrhage", any_flag(keys))
        .withColumn("is_normal", F.col("any_hemorrhage") == 0)
        .withColumn("present_subtypes", present_text(keys))
    )


def read_long_labels(spark: SparkSession, path: str, duplicates: str = "error") -> DataFrame:
    return long_labels(spark.read.schema(schemas.LONG_LABELS).csv(path, header=True), duplicates=duplicates)


def retype_index(df: DataFrame, flag: str = "is_normal") -> DataFrame:
    """``True`` / ``1`` / ``true`` become true, anything else false."""
    return df.withColumn(flag, F.coalesce(F.col(flag).cast("string").isin("True", "1", "true"), F.lit(False)))


def read_manifest(spark: SparkSession, path: str, duplicates: str = "error", pool: bool = False) -> DataFrame:
    """Manifest keyed by image_file; duplicate keys raise unless kept."""
    schema = schemas.POOL_MANIFEST_FILE if pool else schemas.MANIFEST_FILE
    df = retype_index(read_named_csv(spark, path, schema))
    return unique_by(df, "image_file", duplicates)


def image_stem(path: str | Column) -> Column:
    """File name without its last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def parse_listing(listing: DataFrame, path: str = "path") -> DataFrame:
    """Append study_id (third path part) and image_id (after the first ``-`` of the file
    name, before its last dot)."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return listing.withColumn("study_id", F.get(parts, F.lit(2))).withColumn(
        "image_id", F.regexp_replace(F.regexp_extract(name, r"(?s)^[^-]*-(.*)$", 1), r"\.[^.]*$", "")
    )


def as_manifest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Manifest columns in file order; fields a source lacks are null."""
    names = columns or [f.name for f in schemas.MANIFEST_FILE]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in names])


__all__ = [
    "as_manifest", "image_stem", "long_labels", "parse_listing", "read_long_labels", "read_manifest", "read_named_csv",
    "read_wide_labels", "retype_index", "wide_labels",
]
