"""Comparison tables, audits, agreement, throughput and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit.operators import metrics as M
from assaykit.operators import reports as P
from assaykit.operators import resample as R
from assaykit.plans.evaluation import run_state, state_health, state_missed, state_scores, summarise_runs
from suite import register
from suite.answers import _PASS_SQL, CLASS_SQL, GATE_ANSWERS, REPORTS
from suite.derived import LABELS, oracle, spark_sql, table
from suite.metrics import MISSED_SUMMARY, _KEYED_BOOT, cell_ci_sql, keyed_sql, rounded, scored_sql

_RUNS = "SELECT 'base' AS run, 'DOCS' AS dataset, 'No context' AS method UNION ALL SELECT 'text', 'DOCS', 'Text' UNION ALL SELECT 'image', 'DOCS', 'Image' UNION ALL SELECT 'later', 'DOCS', 'Not run yet'"
_HEALTH = "SELECT run, count(*) AS n, avg((NOT parsed)::int) AS pf, avg(refused::int) AS rf FROM {results} GROUP BY run"


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return run_state(table(spark, sf, "pairs"), labels=LABELS)


def _headline(state: DataFrame) -> DataFrame:
    return state_scores(state, labels=LABELS).filter(F.col("class") == V.ANY)


def _table(spark: SparkSession, state: DataFrame, scores: DataFrame) -> DataFrame:
    return P.comparison(scores, state_health(state), state_missed(state, labels=LABELS), spark.sql(_RUNS))


_CI = cell_ci_sql(_KEYED_BOOT, 42)


@register(
    "run_comparison",
    oracle(f"WITH {_CI} SELECT r.run, r.dataset, r.method, h.n, round(s.f1, 6) AS f1, round(ci.f1_lo, 6) AS f1_lo, round(ci.f1_hi, 6) AS f1_hi, round(s.precision, 6) AS precision, round(s.recall, 6) AS recall, "
           f"m.n_missed, m.n_positive, m.n_missed + s.tp AS missed_of, m.missed_rate, round(h.pf, 6) AS parse_failure_rate, round(h.rf, 6) AS refusal_rate "
           f"FROM ({_RUNS}) r LEFT JOIN ({scored_sql()}) s ON s.run = r.run AND s.class = 'any_hemorrhage' LEFT JOIN ci ON ci.run = r.run AND ci.class = 'any_hemorrhage' "
           f"LEFT JOIN ({_HEALTH}) h ON h.run = r.run LEFT JOIN ({MISSED_SUMMARY}) m ON m.run = r.run"),
)
def run_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Method by dataset with intervals, from one scan; a registered run without results keeps its row."""
    cols = ["f1", "f1_lo", "f1_hi", "precision", "recall", "missed_rate", "parse_failure_rate", "refusal_rate"]
    state = _state(spark, sf)
    return rounded(_table(spark, state, R.cell_ci(_headline(state), n_boot=_KEYED_BOOT)), *cols).select("run", "dataset", "method", "n", *cols, "n_missed", "n_positive", "missed_of")


@register(
    "comparison_markdown",
    oracle(f"WITH {keyed_sql(_KEYED_BOOT, 42)}, o AS (SELECT run, f1, row_number() OVER (PARTITION BY run ORDER BY f1) - 1 AS r FROM scored WHERE class = 'any_hemorrhage'), "
           "ci AS (SELECT run, max(f1) FILTER (r = 5) AS lo, max(f1) FILTER (r = 195) AS hi FROM o GROUP BY run) "
           "SELECT r.dataset, r.method, concat('| ', r.dataset, ' | ', r.method, ' | ', h.n, printf(' | %.3f | [%.3f, %.3f] | %.3f | %.3f | %.1f%% (', s.f1, ci.lo, ci.hi, s.precision, s.recall, m.rate * 100), "
           "m.n_missed, '/', m.n_missed + s.tp, printf(') | %.1f%% | %.1f%% |', h.pf * 100, h.rf * 100)) AS line "
           f"FROM ({_RUNS}) r JOIN ({scored_sql()}) s ON s.run = r.run AND s.class = 'any_hemorrhage' JOIN ci ON ci.run = r.run "
           f"JOIN ({_HEALTH}) h ON h.run = r.run JOIN (SELECT *, n_missed / n_positive AS rate FROM ({MISSED_SUMMARY})) m ON m.run = r.run"),
)
def comparison_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """The same table as text; its intervals come from rows resampled one by one."""
    state = _state(spark, sf)
    scores = _headline(state)
    ci = R.keyed_ci(R.keyed_bootstrap(scores, n_boot=_KEYED_BOOT, seed=42), ["run", "class"], _KEYED_BOOT)
    return P.markdown_rows(_table(spark, state, scores.join(ci, ["run", "class"])))


@register(
    "label_grid",
    oracle("SELECT run, " + ", ".join(
        f"round(max(f1) FILTER (class = '{k}'), 6) AS {k}_f1, max(support) FILTER (class = '{k}') AS {k}_support" for k in LABELS)
        + f" FROM ({scored_sql()}) GROUP BY run"),
)
def label_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.label_grid(state_scores(_state(spark, sf), labels=LABELS)), *[f"{k}_f1" for k in LABELS])


@register(
    "model_grid",
    oracle(f"WITH {_CI} SELECT s.class AS category, " + ", ".join(
        f"round(max(s.f1) FILTER (s.run = '{r}'), 6) AS {r}_f1, round(max(ci.f1_lo) FILTER (s.run = '{r}'), 6) AS {r}_lo, round(max(ci.f1_hi) FILTER (s.run = '{r}'), 6) AS {r}_hi" for r in ("base", "image"))
        + f" FROM ({scored_sql()}) s JOIN ci ON ci.run = s.run AND ci.class = s.class WHERE s.class IN ('any_hemorrhage', 'IPH', 'SAH') GROUP BY s.class"),
)
def model_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Category by model: F1 and its interval."""
    kept = F.col("class").isin("any_hemorrhage", "IPH", "SAH") & F.col("run").isin("base", "image")
    scores = R.cell_ci(state_scores(_state(spark, sf), labels=LABELS).filter(kept), n_boot=_KEYED_BOOT)
    bars = P.labelled_union({r: scores.filter(F.col("run") == r).drop("run") for r in ("base", "image")}, "model")
    grid = P.model_grid(bars.withColumnRenamed("class", "category"), ["base", "image"])
    return rounded(grid, *[c for c in grid.columns if c != "category"])


_CELLS = ["precision", "recall", "f1", "tp", "fp", "fn", "support", "f1_lo", "f1_hi"]
_WHOLE = ("tp", "fp", "fn", "support")


def _cell_sql(c: str) -> str:
    one = lambda f: f"max({'ci' if f.startswith('f1_') else 's'}.{f}) FILTER (s.class = '{c}')"
    return ", ".join(f"{one(f) if f in _WHOLE else f'round({one(f)}, 6)'} AS {c}_{f}" for f in _CELLS)


@register(
    "run_summaries",
    oracle(f"WITH {_CI}, w AS (SELECT s.run, {', '.join(map(_cell_sql, ['any_hemorrhage', *LABELS]))}, round(avg(s.f1) FILTER (s.class <> 'any_hemorrhage'), 6) AS macro_f1 "
           f"FROM ({scored_sql()}) s JOIN ci ON ci.run = s.run AND ci.class = s.class GROUP BY s.run), "
           "k AS (SELECT run, string_agg(method || '=' || c, ',' ORDER BY method) AS method_counts, sum(c)::BIGINT AS n FROM (SELECT run, method, count(*) AS c FROM {pairs} GROUP BY run, method) GROUP BY run), "
           "h AS (SELECT run, count(*) FILTER (NOT parsed) AS n_failed, count(*) FILTER (refused) AS n_refused, round(avg((NOT parsed)::int), 6) AS parse_failure_rate, round(avg(refused::int), 6) AS refusal_rate FROM {pairs} GROUP BY run) "
           f"SELECT w.*, k.n, k.method_counts, h.* EXCLUDE (run), m.* EXCLUDE (run, missed_rate), round(m.n_missed / m.n_positive, 6) AS missed_rate, 'negative' AS uncertain_policy "
           f"FROM w JOIN k ON k.run = w.run JOIN h ON h.run = w.run JOIN ({MISSED_SUMMARY}) m ON m.run = w.run"),
)
def run_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """The nested summary of all runs in one job, read back field by field."""
    out = summarise_runs(table(spark, sf, "results"), table(spark, sf, "manifest"), n_boot=_KEYED_BOOT)
    cells = {c: F.col("any_hemorrhage") if c == V.ANY else F.col("per_subtype")[c] for c in [V.ANY, *LABELS]}
    fields = [(cell[f] if f in _WHOLE else F.round(cell[f], 6)).alias(f"{c}_{f}") for c, cell in cells.items() for f in _CELLS]
    methods = F.array_join(F.array_sort(F.transform(F.map_entries("method_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",")
    flat = out.select("run", "n", "uncertain_policy", "n_failed", "n_refused", "parse_failure_rate", "refusal_rate", "macro_f1", methods.alias("method_counts"), *fields, "missed.*")
    return rounded(flat, "parse_failure_rate", "refusal_rate", "macro_f1", "missed_rate")


# -- audits -------------------------------------------------------------------

# the manifest's reports are expected to answer; web pages are expected to be refused
_PAGE_ANSWERS = (
    "SELECT concat('web/page_', cast(page_id AS string), '.png') AS image_file, CASE WHEN substr(md5(cast(page_id AS string)), 1, 1) < '3' "
    "THEN concat(html, ' Objective Findings Impression') ELSE html END AS raw_text FROM {pages}"
)
_VALID_ANSWERS = f"SELECT m.image_file, r.raw_text FROM {{manifest}} m JOIN ({REPORTS}) r ON m.doc_id = r.doc_id"
_RECORDS = (
    f"SELECT i.image_file, i.any_hemorrhage, i.expect, {CLASS_SQL} AS label FROM ("
    "SELECT image_file, any_hemorrhage, 'answered' AS expect FROM {manifest} UNION ALL "
    f"SELECT concat('web/page_', cast(page_id AS string), '.png'), NULL, 'refused' FROM {{pages}}) i JOIN ({_VALID_ANSWERS} UNION ALL {_PAGE_ANSWERS}) a ON a.image_file = i.image_file"
)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".png")).alias("image_file"))
    items = P.expected_items(table(spark, sf, "manifest"), {"web": pages})
    answers = spark_sql(spark, sf, _VALID_ANSWERS).unionByName(spark_sql(spark, sf, _PAGE_ANSWERS))
    return P.refusal_records(items, answers)


@register(
    "refusal_records",
    oracle(f"SELECT image_file, any_hemorrhage, expect, label, CASE WHEN label = 'answered' THEN 'answered' ELSE 'refused' END AS got, "
           f"(label = 'answered') = (expect = 'answered') AS ok FROM ({_RECORDS})"),
)
def refusal_records(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).select("image_file", "any_hemorrhage", "expect", "label", "got", "ok")


@register(
    "refusal_audit",
    oracle(f"SELECT any_hemorrhage, label, count(*) AS n, count(*) FILTER ((label = 'answered') <> (expect = 'answered')) AS n_mismatch, "
           f"round(count(*) / sum(count(*)) OVER (PARTITION BY any_hemorrhage), 6) AS share FROM ({_RECORDS}) GROUP BY any_hemorrhage, label"),
)
def refusal_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.refusal_audit(_records(spark, sf), ["any_hemorrhage"]), "share")


_OUTCOMES = (
    f"SELECT conv_id, turn, expected, CASE WHEN expected = 'answer' AND NOT {_PASS_SQL} THEN 'false_refusal' "
    f"WHEN expected = 'refuse' AND {_PASS_SQL} THEN 'false_pass' END AS error FROM ({GATE_ANSWERS})"
)


@register("gate_errors", oracle(f"SELECT * FROM ({_OUTCOMES}) WHERE error IS NOT NULL"))
def gate_errors(spark: SparkSession, sf: str) -> DataFrame:
    out = P.gate_outcomes(spark_sql(spark, sf, GATE_ANSWERS))
    return out.filter(F.col("error").isNotNull()).select("conv_id", "turn", "expected", "error")


@register(
    "gate_audit",
    oracle(f"SELECT *, round(n_false_refusal / n_valid, 6) AS false_refusal_rate, round(n_false_pass / n_defensive, 6) AS false_pass_rate, "
           f"n_false_refusal = 0 AND n_false_pass = 0 AS ok FROM (SELECT count(*) FILTER (expected = 'answer') AS n_valid, count(*) FILTER (error = 'false_refusal') AS n_false_refusal, "
           f"count(*) FILTER (expected = 'refuse') AS n_defensive, count(*) FILTER (error = 'false_pass') AS n_false_pass FROM ({_OUTCOMES}))"),
)
def gate_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.gate_audit(P.gate_outcomes(spark_sql(spark, sf, GATE_ANSWERS))), "false_refusal_rate", "false_pass_rate")


@register(
    "throughput",
    oracle("SELECT event_type, count(*) AS n, count(*) FILTER (value < 300) AS n_ok, round(count(*) FILTER (value < 300) / count(*), 6) AS ok_share, round(median(value) FILTER (value < 300), 6) AS median_seconds, sum(tok) FILTER (value < 300) AS tokens, "
           "round(sum(value) FILTER (value < 300), 4) AS seconds, round(sum(tok) FILTER (value < 300) / sum(value) FILTER (value < 300), 6) AS tokens_per_second, "
           "round(max(value / 20), 6) AS peak_memory_gb, max(value / 20) < 15 AS fits FROM (SELECT *, json_extract(props, '$.k')::bigint AS tok FROM {events}) GROUP BY event_type"),
)
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Event values as seconds, the JSON property as tokens."""
    runs = table(spark, sf, "events").select(
        "event_type", F.col("value").alias("generation_seconds"), F.get_json_object("props", "$.k").cast("long").alias("new_tokens"),
        F.when(F.col("value") < 300, F.lit("ok")).otherwise(F.lit("error")).alias("status"), (F.col("value") / 20).alias("peak_vram_reserved_gb"),
    )
    out = P.throughput(runs, ["event_type"])
    return rounded(out.withColumn("seconds", F.round("seconds", 4)), "tokens_per_second", "peak_memory_gb", "ok_share", "median_seconds")


# -- agreement ----------------------------------------------------------------


@register(
    "run_agreement",
    oracle("SELECT count(*) AS n, count(*) FILTER (a.pred_any_hem IS NOT DISTINCT FROM b.pred_any_hem) AS n_equal, "
           "round(count(*) FILTER (a.pred_any_hem IS NOT DISTINCT FROM b.pred_any_hem) / count(*), 6) AS agreement "
           "FROM {results} a JOIN {results} b ON a.image_file = b.image_file WHERE a.run = 'text' AND b.run = 'image'"),
)
def run_agreement(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results")
    return rounded(P.agreement(r.filter(F.col("run") == "text"), r.filter(F.col("run") == "image")), "agreement")


@register(
    "missed_everywhere",
    oracle("SELECT image_file FROM {pairs} WHERE any_hemorrhage = 1 AND (pred_any_hem IS NULL OR pred_any_hem <> 1) GROUP BY image_file HAVING count(DISTINCT run) = 3"),
)
def missed_everywhere(spark: SparkSession, sf: str) -> DataFrame:
    return P.missed_everywhere(M.missed_cases(table(spark, sf, "pairs")), 3)


@register(
    "metric_shifts",
    oracle(f"WITH s AS ({scored_sql()}) SELECT s.run, s.class, round(s.precision - b.precision, 6) AS precision_shift, round(s.recall - b.recall, 6) AS recall_shift, "
           "round(s.f1 - b.f1, 6) AS f1_shift FROM s JOIN s b ON b.class = s.class AND b.run = 'base' WHERE s.run <> 'base'"),
)
def metric_shifts(spark: SparkSession, sf: str) -> DataFrame:
    out = P.metric_shifts(M.evaluate(table(spark, sf, "pairs")), "base")
    return rounded(out, "precision_shift", "recall_shift", "f1_shift")
