"""Confusion counts, precision / recall / F1, support, health rates, missed cases.

Scoring never stacks one row per (item, class): every class is counted by its own
conditional sums in a single aggregation per run, and only the few result rows are
unpivoted. The sums are folded on the map side, so one run holding most of the
rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.fixed_values import ANY, SUBTYPES
from assaykit.functions.labels import binarise, outcome

# class -> (ground-truth column, prediction column)
DEFAULT_CLASSES = {ANY: (ANY, "pred_any_hem"), **{k: (k, f"pred_{k}") for k in SUBTYPES}}


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf1(df: DataFrame, tp: str = "tp", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Append precision, recall and f1 = 2pr / (p + r)."""
    t, p, n = (F.col(c).cast("double") for c in (tp, fp, fn))
    return (
        df.withColumn("precision", ratio(t, t + p))
        .withColumn("recall", ratio(t, t + n))
        .withColumn(
            "f1",
            ratio(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        )
    )


def join_truth(results: DataFrame, manifest: DataFrame, key: str = "image_file", truth: Sequence[str] = (ANY, *SUBTYPES)) -> DataFrame:
    """Results with their ground truth; results without a manifest row are dropped."""
    return results.join(manifest.select(key, *truth), key, "inner")


def class_counts(
    pairs: DataFrame,
    by: Sequence[str] = ("run",),
    classes: Mapping[str, tuple[str, str]] = DEFAULT_CLASSES,
    policy: str = "negative",
) -> DataFrame:
    """(by…, class, n, tp, fp, fn, support): one aggregation, then a small unpivot."""
    wide = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *class_sums(classes, policy))
    return wide.select(*by, "n", class_rows(classes))


def class_sums(classes: Mapping[str, tuple[str, str]] = DEFAULT_CLASSES, policy: str = "negative") -> list[Column]:
    """Aggregates of ``class_counts``, to be put into a larger aggregation."""
    sums = []
    for i, (g, p) in enumerate(classes.values()):
        kind = outcome(F.col(g), F.col(p), policy)
        sums += [F.count_if(kind == F.lit(o)).alias(f"__{o}{i}") for o in ("tp", "fp", "fn")]
        sums.append(F.coalesce(F.sum(F.col(g).cast("long")), F.lit(0)).alias(f"__sup{i}"))
    return sums


def class_rows(classes: Mapping[str, tuple[str, str]] = DEFAULT_CLASSES) -> Column:
    """The columns of ``class_sums`` as one row per class."""
    rows = [
        F.struct(
            F.lit(c).alias("class"),
            F.col(f"__tp{i}").alias("tp"),
            F.col(f"__fp{i}").alias("fp"),
            F.col(f"__fn{i}").alias("fn"),
            F.col(f"__sup{i}").alias("support"),
        )
        for i, c in enumerate(classes)
    ]
    return F.inline(F.array(*rows))


def evaluate(
    pairs: DataFrame,
    by: Sequence[str] = ("run",),
    classes: Mapping[str, tuple[str, str]] = DEFAULT_CLASSES,
    policy: str = "negative",
) -> DataFrame:
    """Per-class table: counts, support, precision, recall, f1."""
    return prf1(class_counts(pairs, by, classes, policy))


def macro_f1(per_class: DataFrame, by: Sequence[str] = ("run",), exclude: Sequence[str] = (ANY,)) -> DataFrame:
    """Unweighted mean of the class F1 values (the binary headline class is left out)."""
    return (
        per_class.filter(~F.col("class").isin(*exclude))
        .groupBy(*by)
        .agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))
    )


def parse_health(results: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Parse-failure and refusal rates."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *health_sums())


def health_sums() -> list[Column]:
    return [
        F.count_if(~F.col("parsed")).alias("n_failed"),
        F.count_if(F.col("refused")).alias("n_refused"),
        F.avg((~F.col("parsed")).cast("double")).alias("parse_failure_rate"),
        F.avg(F.col("refused").cast("double")).alias("refusal_rate"),
    ]


def method_counts(results: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    return results.groupBy(*by, "method").agg(F.count(F.lit(1)).alias("n"))


def missed_cases(pairs: DataFrame, policy: str = "negative", gt: str = ANY, pred: str = "pred_any_hem") -> DataFrame:
    """Rows whose ground truth is positive and whose prediction is negative.

    The list stays a table: a run may miss millions of cases.
    """
    return pairs.filter((binarise(F.col(gt), policy) == 1) & (binarise(F.col(pred), policy) == 0))


def missed_summary(
    pairs: DataFrame,
    by: Sequence[str] = ("run",),
    labels: Sequence[str] = SUBTYPES,
    policy: str = "negative",
    gt: str = ANY,
    pred: str = "pred_any_hem",
) -> DataFrame:
    """Missed positives: count, share of all positives, count per label."""
    agg = pairs.groupBy(*by).agg(*missed_sums(labels, policy, gt, pred))
    return agg.withColumn("missed_rate", missed_rate())


def missed_sums(
    labels: Sequence[str] = SUBTYPES, policy: str = "negative", gt: str = ANY, pred: str = "pred_any_hem"
) -> list[Column]:
    missed = (binarise(F.col(gt), policy) == 1) & (binarise(F.col(pred), policy) == 0)
    return [
        F.count_if(missed).alias("n_missed"),
        F.sum(F.col(gt).cast("long")).alias("n_positive"),
        *[F.coalesce(F.sum(F.when(missed, F.col(k).cast("long"))), F.lit(0)).alias(f"missed_{k}") for k in labels],
    ]


def missed_rate() -> Column:
    return ratio(F.col("n_missed").cast("double"), F.col("n_positive").cast("double"))


def manifest_summary(
    manifest: DataFrame,
    by: Sequence[str] = (),
    labels: Sequence[str] = SUBTYPES,
    distinct: Sequence[str] = (),
) -> DataFrame:
    """Rows, normal share, count per label and distinct groups of a manifest."""
    normal = F.col("is_normal").cast("boolean")
    return manifest.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(normal).alias("n_normal"),
        F.avg(normal.cast("double")).alias("normal_share"),
        F.count_if(~normal).alias("n_positive"),
        *[F.sum(F.col(k).cast("long")).alias(f"n_{k}") for k in labels],
        *[F.count_distinct(F.col(d)).alias(f"distinct_{d}") for d in distinct],
    )
