"""Run comparisons, audits and agreement: report tables as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit.functions.answers import passes_gate, response_class
from assaykit.operators.quantiles import exact_quantile


def comparison(scores: DataFrame, health: DataFrame, missed: DataFrame, runs: DataFrame, headline: str = V.ANY) -> DataFrame:
    """One row per registered run; a run without a summary stays, with nulls.

    ``missed_of`` is missed + tp, the denominator the table shows; under the ignore
    policy it can differ from ``n_positive``.
    """
    head = scores.filter(F.col("class") == headline).drop("class", "support", "n")
    return (
        runs.join(health, "run", "left")
        .join(head, "run", "left")
        .join(missed.select("run", "n_missed", "n_positive", "missed_rate"), "run", "left")
        .withColumn("missed_of", F.col("n_missed") + F.col("tp"))
    )


def markdown_rows(table: DataFrame) -> DataFrame:
    """(dataset, method, line): the text of each comparison row."""

    def pct(c: str) -> Column:
        return F.concat(F.format_string("%.1f", F.col(c) * 100), F.lit("%"))

    def three(c: str) -> Column:
        return F.format_string("%.3f", F.col(c))

    line = F.concat(
        F.lit("| "), F.col("dataset"), F.lit(" | "), F.col("method"), F.lit(" | "), F.col("n").cast("string"),
        F.lit(" | "), three("f1"), F.lit(" | ["), three("f1_lo"), F.lit(", "), three("f1_hi"), F.lit("] | "),
        three("precision"), F.lit(" | "), three("recall"), F.lit(" | "), pct("missed_rate"), F.lit(" ("),
        F.col("n_missed").cast("string"), F.lit("/"), F.col("missed_of").cast("string"), F.lit(") | "),
        pct("parse_failure_rate"), F.lit(" | "), pct("refusal_rate"), F.lit(" |"),
    )
    return table.filter(F.col("f1").isNotNull()).select("dataset", "method", line.alias("line"))


MARKDOWN_HEADER = (
    "| Dataset | Method | n | F1 | 95% CI | P | R | Dangerous FN rate | Parse fail | Refusal |",
    "|---|---|---|---|---|---|---|---|---|---|",
)


def label_grid(scores: DataFrame, rows: Sequence[str] = ("run",), labels: Sequence[str] = V.SUBTYPES) -> DataFrame:
    """Method × label grid of F1 with support: columns <label>_f1 and <label>_support."""
    return (
        scores.groupBy(*rows)
        .pivot("class", list(labels))
        .agg(F.first("f1").alias("f1"), F.first("support").alias("support"))
    )


def model_grid(bars: DataFrame, models: Sequence[str], rows: Sequence[str] = ("category",)) -> DataFrame:
    """Category × model grid of F1 with its interval."""
    return (
        bars.groupBy(*rows)
        .pivot("model", list(models))
        .agg(F.first("f1").alias("f1"), F.first("f1_lo").alias("lo"), F.first("f1_hi").alias("hi"))
    )


def labelled_union(parts: Mapping[str, DataFrame], name: str = "panel") -> DataFrame:
    """Stack labelled sources into one table."""
    out = None
    for label, df in parts.items():
        tagged = df.withColumn(name, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to union")
    return out


# -- audits -------------------------------------------------------------------


def expected_items(valid: DataFrame, defensive: Mapping[str, DataFrame], key: str = "image_file") -> DataFrame:
    """Valid images (expected: answered) and defensive sets (expected: refused)."""
    items = valid.select(key, F.col("any_hemorrhage").cast("int").alias("any_hemorrhage"), F.lit("answered").alias("expect"))
    for label, df in defensive.items():
        items = items.unionByName(
            df.select(
                F.concat(F.lit(f"{label}/"), F.col(key)).alias(key),
                F.lit(None).cast("int").alias("any_hemorrhage"),
                F.lit("refused").alias("expect"),
            )
        )
    return items


def refusal_records(items: DataFrame, answers: DataFrame, key: str = "image_file", text: str = "raw_text") -> DataFrame:
    """Expected against observed: label, got, ok per item.

    An item without an answer stays, with label and got null and ``ok`` false.
    """
    known = answers.select(key, text).withColumn("__answered", F.lit(True))
    label = F.when(F.col("__answered"), response_class(F.col(text)))
    return (
        items.join(known, key, "left")
        .withColumn("label", label)
        .withColumn("got", F.when(F.col("label") == "answered", F.lit("answered")).when(F.col("label").isNotNull(), F.lit("refused")))
        .withColumn("ok", F.coalesce(F.col("got") == F.col("expect"), F.lit(False)))
        .drop("__answered")
        .withColumn("text_preview", F.substring(text, 1, 300))
        .drop(text)
    )


def refusal_audit(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count and share per response class, and mismatches, optionally per group."""
    counted = records.groupBy(*by, "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("n_mismatch")
    )
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def gate_outcomes(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Append ``passed`` and ``error`` (false_refusal / false_pass) by ``expected`` answer / refuse."""
    passed = passes_gate(F.col(answer))
    return answers.withColumn("passed", passed).withColumn(
        "error",
        F.when((F.col("expected") == "answer") & ~F.col("passed"), F.lit("false_refusal")).when(
            (F.col("expected") == "refuse") & F.col("passed"), F.lit("false_pass")
        ),
    )


def gate_audit(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False-refusal and false-pass counts and rates; ok only if both are zero."""
    valid, foreign = F.col("expected") == "answer", F.col("expected") == "refuse"
    agg = outcomes.groupBy(*by).agg(
        F.count_if(valid).alias("n_valid"),
        F.count_if(F.col("error") == "false_refusal").alias("n_false_refusal"),
        F.count_if(foreign).alias("n_defensive"),
        F.count_if(F.col("error") == "false_pass").alias("n_false_pass"),
    )
    return (
        agg.withColumn("false_refusal_rate", F.try_divide("n_false_refusal", "n_valid"))
        .withColumn("false_pass_rate", F.try_divide("n_false_pass", "n_defensive"))
        .withColumn("ok", (F.col("n_false_refusal") == 0) & (F.col("n_false_pass") == 0))
    )


def throughput(
    runs: DataFrame, by: Sequence[str], seconds: str = "generation_seconds", tokens: str = "new_tokens",
    status: str = "status", memory: str = "peak_vram_reserved_gb", limit: float = V.MEMORY_LIMIT_GB,
) -> DataFrame:
    """Tokens per second, median seconds (of the answered), ok share and memory fit per group.

    The median is exact, and found by narrowing: a group that holds most rows is never in one task.
    """
    ok = F.col(status) == "ok"
    median = exact_quantile(runs.where(ok), by, seconds, 0.5, "median_seconds").select(*[F.col(c).alias(f"__{c}") for c in by], "median_seconds")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.lit(True))
    totals = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(ok).alias("n_ok"),
        (F.count_if(ok) / F.count(F.lit(1))).alias("ok_share"),
        F.sum(F.when(ok, F.col(tokens))).alias("tokens"),
        F.sum(F.when(ok, F.col(seconds))).alias("seconds"),
        F.try_divide(F.sum(F.when(ok, F.col(tokens))), F.sum(F.when(ok, F.col(seconds)))).alias("tokens_per_second"),
        F.max(memory).alias("peak_memory_gb"),
        (F.max(memory) < limit).alias("fits"),
    )
    kept = [c for c in totals.columns if c not in (*by, "n", "n_ok", "ok_share")]
    return totals.join(median, same, "left").select(*by, "n", "n_ok", "ok_share", "median_seconds", *kept)


# -- agreement across runs ----------------------------------------------------


def agreement(a: DataFrame, b: DataFrame, key: str = "image_file", pred: str = "pred_any_hem") -> DataFrame:
    """One row: shared items, equal predictions (two nulls are equal), share."""
    both = a.select(key, F.col(pred).alias("__a")).join(b.select(key, F.col(pred).alias("__b")), key)
    return both.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__a").eqNullSafe(F.col("__b"))).alias("n_equal")
    ).withColumn("agreement", F.try_divide("n_equal", "n"))


def missed_everywhere(missed: DataFrame, n_runs: int, key: str = "image_file", run: str = "run") -> DataFrame:
    """Items missed in every one of ``n_runs`` runs."""
    return (
        missed.select(key, run)
        .distinct()
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n_missed"))
        .filter(F.col("n_missed") == n_runs)
        .select(key)
    )


def metric_shifts(scores: DataFrame, baseline: str, within: Sequence[str] = ("class",), run: str = "run") -> DataFrame:
    """Precision, recall and F1 of every run minus the baseline run's."""
    base = scores.filter(F.col(run) == baseline).select(
        *within, *[F.col(c).alias(f"__{c}") for c in ("precision", "recall", "f1")]
    )
    return scores.filter(F.col(run) != baseline).join(base, list(within)).select(
        run, *within, *[(F.col(c) - F.col(f"__{c}")).alias(f"{c}_shift") for c in ("precision", "recall", "f1")]
    )
