"""Result logs, run summaries and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit import schemas
from assaykit.operators.keys import unique_by


INGEST = "ingest"


def ingest_place() -> list[Column]:
    """Where a record was read: file time, file, place of the split. Later files come after earlier ones."""
    names = {"time": "file_modification_time", "file": "file_path", "block": "file_block_start"}
    return [F.col(f"_metadata.{v}").alias(k) for k, v in names.items()]


def ingest_order() -> Column:
    """The place, and the line within the split: what "last" means for a log without a sequence number of its own."""
    return F.struct(*ingest_place(), F.monotonically_increasing_id().alias("line"))


def read_results(spark: SparkSession, path: str, schema: T.StructType = schemas.RESULTS) -> DataFrame:
    """Result records from JSON lines with their ``ingest`` order; blank lines give no row, broken lines raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn(INGEST, ingest_order())


def last_per_key(results: DataFrame, keys: Sequence[str] = ("image_file",), order: str | Column | None = None) -> DataFrame:
    """The latest record per key: by ``order``, else by the log's ``seq`` where it has one and then by ingest order."""
    if order is None:
        named = [c for c in ("seq", INGEST) if c in results.columns]
        if not named:
            raise ValueError("the records carry no order; name one")
        order = F.struct(*named) if INGEST in named else F.col("seq")
    return unique_by(results, list(keys), "last", order).drop(INGEST)


def done_keys(spark: SparkSession, path: str, key: str = "image_file") -> DataFrame:
    """Keys already answered in a log that may hold broken or keyless lines."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("_corrupt_record", T.StringType())])
    return (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .json(path)
        .filter(F.col("_corrupt_record").isNull() & F.col(key).isNotNull())
        .select(key)
        .distinct()
    )


def write_results(records: DataFrame, path: str, mode: str = "append") -> None:
    """Append records to the run-partitioned table."""
    records.write.mode(mode).partitionBy("run").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """A run-partitioned table whose ``run`` is text: names such as 007 are not read as numbers."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name == "run" else f for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def read_run_table(spark: SparkSession, path: str, runs: DataFrame, key: str = "run") -> DataFrame:
    """Left join of the run registry with a run-partitioned table; ``found`` tells missing runs."""
    stored = read_runs(spark, path).withColumn("found", F.lit(True))
    return runs.join(stored, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def write_table(df: DataFrame, path: str, columns: Sequence[str], fmt: str = "parquet", mode: str = "error") -> None:
    """Write a column subset as parquet, json or csv (with header); other columns are ignored."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown format: {fmt!r}")
    writer = df.select(*columns).write.mode(mode)
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_index(df: DataFrame, path: str, key: str = "image_file", vector: str = "embedding", mode: str = "error") -> None:
    """Embedding index: one row-keyed table, so labels and vectors cannot slip apart."""
    unique_by(df, key).withColumn(vector, F.col(vector).cast("array<float>")).write.mode(mode).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
