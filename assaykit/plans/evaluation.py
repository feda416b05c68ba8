"""Scoring of many runs at once, and the retrieval decision."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit.operators.images import match_image
from assaykit.operators.metrics import (
    DEFAULT_CLASSES,
    class_rows,
    class_sums,
    health_sums,
    join_truth,
    missed_rate,
    missed_sums,
    prf1,
)
from assaykit.operators.nearest import nearest
from assaykit.operators.resample import cell_ci, null_verdict, permutation_null
from assaykit.operators.retrieval import hit_rate
from assaykit.session import cut_lineage


HEALTH = ["n_failed", "n_refused", "parse_failure_rate", "refusal_rate"]
METHODS = ("structured", "fallback", "failed")


def run_state(
    pairs: DataFrame, by: Sequence[str] = ("run",), policy: str = "negative", labels: Sequence[str] = V.SUBTYPES
) -> DataFrame:
    """One row per run that holds what every report on it needs, from one scan of ``pairs``; stored.

    Comparison, summary and grids are cut from it by the functions below, whatever their number.
    """
    # results that don't say how they were parsed have no counts
    method = F.col("method") if "method" in pairs.columns else F.lit(None).cast("string")
    methods = [F.count_if(method == m).alias(f"__method_{m}") for m in METHODS]
    sums = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *class_sums(_classes(labels), policy), *health_sums(), *missed_sums(labels, policy), *methods
    )
    return cut_lineage(sums.withColumn("missed_rate", missed_rate()))


def _classes(labels: Sequence[str]) -> dict[str, tuple[str, str]]:
    return {V.ANY: DEFAULT_CLASSES[V.ANY], **{k: (k, f"pred_{k}") for k in labels}}


def state_scores(state: DataFrame, by: Sequence[str] = ("run",), labels: Sequence[str] = V.SUBTYPES, carry: Sequence[str] = ()) -> DataFrame:
    """(by…, class, n, tp, fp, fn, support, precision, recall, f1) of a state."""
    return prf1(state.select(*by, "n", *carry, class_rows(_classes(labels))))


def state_health(state: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    return state.select(*by, "n", *HEALTH)


def state_missed(state: DataFrame, by: Sequence[str] = ("run",), labels: Sequence[str] = V.SUBTYPES) -> DataFrame:
    return state.select(*by, "n_missed", "n_positive", *[f"missed_{k}" for k in labels], "missed_rate")


def state_methods(state: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """(by…, method_counts): how many answers each way of parsing settled; ways that occur."""
    counts = F.create_map(*[x for m in METHODS for x in (F.lit(m), F.col(f"__method_{m}"))])
    return state.select(*by, F.map_filter(counts, lambda _, n: n > 0).alias("method_counts"))


def summarise_runs(
    results: DataFrame, manifest: DataFrame, by: Sequence[str] = ("run",), policy: str = "negative",
    labels: Sequence[str] = V.SUBTYPES, n_boot: int = V.N_BOOT, seed: int = 42,
) -> DataFrame:
    """One nested row per run: rates, ways of parsing, headline class, per-label map, macro F1, missed positives.

    Results and manifest are joined and read once: every figure comes from one
    aggregation per run, the intervals from its few result rows.
    """
    by = list(by)
    missed = ["n_missed", "n_positive", "missed_rate", *[f"missed_{k}" for k in labels]]
    state = run_state(join_truth(results, manifest, truth=(V.ANY, *labels)), by, policy, labels)
    scored = cell_ci(state_scores(state, by, labels, [*HEALTH, *missed]), [*by, "class"], n_boot, seed)
    cells = F.struct("precision", "recall", "f1", "tp", "fp", "fn", "support", "f1_lo", "f1_hi")
    label = F.col("class") != V.ANY
    # a run has one row per class: the collected map has len(labels) entries
    entries = F.collect_list(F.when(label, F.struct(F.col("class").alias("key"), cells.alias("value"))))
    nested = scored.groupBy(*by, "n", *HEALTH, *missed).agg(
        F.first(F.when(~label, cells), ignorenulls=True).alias("any_hemorrhage"),
        F.map_from_entries(F.array_sort(entries)).alias("per_subtype"),
        F.avg(F.when(label, F.col("f1"))).alias("macro_f1"),
    )
    return nested.join(state_methods(state, by), by).select(
        *by, "n", F.lit(policy).alias("uncertain_policy"), *HEALTH, "method_counts", "any_hemorrhage", "per_subtype", "macro_f1",
        F.struct(*missed).alias("missed"),
    )


def retrieval_verdict(
    queries: DataFrame, pool: DataFrame, k: int = V.HIT_RATE_K, n_trials: int = V.N_TRIALS, seed: int = 42,
    vector: str = "embedding", labels: str = "labels",
) -> DataFrame:
    """One row: does the real hit rate reach the null's 95th percentile?"""
    real = hit_rate(nearest(queries, pool, k, vector=vector), queries, pool, k, labels=labels)
    return null_verdict(real, permutation_null(queries, pool, k, n_trials, seed, labels))


def retrieval_decision(
    queries: DataFrame, pool: DataFrame, embed_matched: Callable[[DataFrame], DataFrame], reference: DataFrame,
    k: int = V.HIT_RATE_K, n_trials: int = V.N_TRIALS, seed: int = 42, pixels: str = "pixels",
) -> dict[str, object]:
    """Decide on a pool: B if retrieval beats chance, if need be after one histogram
    match to the reference image; C otherwise. Only one-row verdicts reach the driver."""
    first: Row = retrieval_verdict(queries, pool, k, n_trials, seed).first()
    sizes = {"n_query": queries.count(), "n_pool": pool.count()}
    out: dict[str, object] = {**first.asDict(), **sizes, "decision": "B", "histogram_matched": False, "k": k, "n_trials": n_trials}
    if not first["passed"]:
        matched = match_image(pool.drop("embedding"), reference, pixels, pixels)
        second: Row = retrieval_verdict(queries, embed_matched(matched), k, n_trials, seed).first()
        out |= {
            "after_histogram_match": second.asDict(),
            "histogram_matched": True,
            "decision": "B" if second["passed"] else "C",
        }
    return out

