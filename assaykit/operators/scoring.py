"""Batch scoring with user-supplied functions: gate, resume, one record per image."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit import fixed_values as V
from assaykit.functions.answers import parse, passes_gate
from assaykit.operators.splits import todo

ScoreFn = Callable[[pd.DataFrame], pd.DataFrame]
PIECE = 1000  # rows that are answered at once


def gate(answers: DataFrame, answer: str = "gate_answer") -> tuple[DataFrame, DataFrame]:
    """(passed, blocked): blocked rows carry the refusal text and plan no retrieval."""
    flagged = passes_gate(F.col(answer))
    blocked = answers.filter(~flagged).withColumn("raw_text", F.lit(V.GATE_REFUSAL_TEXT))
    return answers.filter(flagged), blocked


def score(work: DataFrame, make_score_fn: Callable[[], ScoreFn], key: str = "image_file", carry: Sequence[str] = ()) -> DataFrame:
    """Answer every row of ``work``.

    ``make_score_fn`` runs once per task and returns a function from a batch to a frame
    with ``raw_text`` and ``n_tokens`` in the same row order. Batches have ``PIECE`` rows at
    most. Timing is per batch, shared evenly over its rows.
    """
    kept = [key, *carry]
    schema = T.StructType(
        [work.schema[c] for c in kept]
        + [T.StructField("raw_text", T.StringType()), T.StructField("gen_seconds", T.DoubleType()), T.StructField("n_tokens", T.IntegerType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = make_score_fn()
        for whole in batches:
            for at in range(0, len(whole), PIECE):
                pdf = whole.iloc[at : at + PIECE].copy()
                begun = time.perf_counter()
                out = answer(pdf)
                each = (time.perf_counter() - begun) / len(pdf)
                yield pdf[kept].assign(
                    raw_text=out["raw_text"].to_numpy(), gen_seconds=each, n_tokens=out["n_tokens"].to_numpy()
                )
                # a frame whose .str or .dt was used holds itself, and with it its texts, until cycles are collected
                del pdf, out
                gc.collect(1)

    return work.mapInPandas(run, schema)


def result_records(answers: DataFrame, run: str, patterns: Mapping[str, str] = V.SUBTYPE_PATTERNS) -> DataFrame:
    """Parsed result records of one run from raw answers."""
    parsed = parse(answers, "raw_text", patterns)
    renamed = parsed.withColumnRenamed("any_hem", "pred_any_hem")
    for k in patterns:
        renamed = renamed.withColumnRenamed(k, f"pred_{k}")
    return renamed.withColumn("run", F.lit(run))


def resume_scoring(
    manifest: DataFrame, done: DataFrame | None, make_score_fn: Callable[[], ScoreFn], run: str, key: str = "image_file",
    carry: Sequence[str] = ("patient", "slice"), partitions: int | None = None,
) -> DataFrame:
    """Records for the manifest rows not done yet; finished rows never reach the model."""
    work = manifest if done is None else todo(manifest, done, [key])
    if partitions:
        # the anti-join keeps file partitions, which may be uneven after a partial run
        work = work.repartition(partitions, key)
    return result_records(score(work, make_score_fn, key, carry), run)
