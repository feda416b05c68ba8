"""From raw documents to packed training sequences: five stages, each one of the corpus operators.

quality classifier (rejected documents go) -> exact dedup -> n-gram Jaccard join (one document of each
group stays) -> mixing sources to target weights (documents repeat or go as the mix draws them) -> best-fit packing.
Every stage takes the rows its predecessor kept; all but the last return the columns of ``documents``.

All stages run on the same executors, whose JVM and Python workers grow over them. So whole texts go to Python in
Arrow batches of at most BATCH_BYTES, a setting of the session that holds from the first stage on unless it was set before.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from assaykit.llm import crf, jaccard, mixing, packing, recipes
from assaykit.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BATCH_BYTES = 4 << 20


def in_small_batches(stage: Stage) -> Stage:
    """The setting stays when the stage returns: its result is yet to be computed."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(limit, None) is None:
            spark.conf.set(limit, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crf.keep_good(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recipes.drop_exact(docs)


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


@in_small_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.drawn(docs).drop("__shard")


@in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram jaccard join", near_dedup),
    ("mixing", mixture),
    ("best-fit packing", packing_stage),
]

# A learnt model, a random mix and a genetic search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
