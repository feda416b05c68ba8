"""Scores: policies, counts, F1, health, missed cases, intervals, significance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.answers import parse
from assaykit.functions.labels import POLICIES, binarise
from assaykit.operators import metrics as M
from assaykit.operators import resample as R
from suite import register
from suite.answers import PARSED
from suite.derived import LABELS, oracle, table

CLASSES = {"any_hemorrhage": ("any_hemorrhage", "pred_any_hem"), **{k: (k, f"pred_{k}") for k in LABELS}}


def bin_sql(col: str, policy: str = "negative") -> str:
    other = {"negative": "0", "positive": "1", "ignore": "NULL"}[policy]
    return f"CASE WHEN {col} IS NULL OR {col} = 0 THEN 0 WHEN {col} = 1 THEN 1 ELSE {other} END"


def long_sql(source: str = "{pairs}", policy: str = "negative") -> str:
    """(run, class, image_file, gt, g, p) rows."""
    return " UNION ALL ".join(
        f"SELECT run, '{c}' AS class, image_file, {g} AS gt, {bin_sql(g, policy)} AS g, {bin_sql(p, policy)} AS p FROM {source}"
        for c, (g, p) in CLASSES.items()
    )


def counts_sql(source: str = "{pairs}", policy: str = "negative") -> str:
    return (
        "SELECT run, class, count(*) AS n, count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (g = 0 AND p = 1) AS fp, "
        f"count(*) FILTER (g = 1 AND p = 0) AS fn, sum(gt) AS support FROM ({long_sql(source, policy)}) GROUP BY run, class"
    )


def scored_sql(source: str = "{pairs}", policy: str = "negative") -> str:
    return (
        "SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM ("
        "SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, "
        f"CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM ({counts_sql(source, policy)}))"
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_SCORE_OUT = "run, class, n, tp, fp, fn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Raw answers to scores: parse, join with ground truth, per-class F1."""
    parsed = parse(table(spark, sf, "answers"), "raw_text")
    renamed = parsed.withColumnsRenamed({"any_hem": "pred_any_hem", **{k: f"pred_{k}" for k in LABELS}})
    return M.evaluate(M.join_truth(renamed, table(spark, sf, "manifest")))


@register(
    "score_answers",
    oracle(
        f"WITH {PARSED}, p AS (SELECT q.run, q.image_file, q.any_hem AS pred_any_hem, "
        + ", ".join(f"q.{k} AS pred_{k}" for k in LABELS)
        + ", m.any_hemorrhage, "
        + ", ".join(f"m.{k}" for k in LABELS)
        + " FROM parsed q JOIN {manifest} m ON q.image_file = m.image_file) "
        f"SELECT {_SCORE_OUT} FROM ({scored_sql('p')})"
    ),
)
def score_answers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(flagship(spark, sf), "precision", "recall", "f1")


@register(
    "binarise_policies",
    oracle(
        "SELECT run, image_file, "
        + ", ".join(f"{bin_sql('pred_any_hem', p)} AS {p}" for p in POLICIES)
        + " FROM {results}"
    ),
)
def binarise_policies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results").select(
        "run", "image_file", *[binarise(F.col("pred_any_hem"), p).alias(p) for p in POLICIES]
    )


def _per_class(policy: str) -> None:
    @register(f"per_class_f1_{policy}", oracle(f"SELECT {_SCORE_OUT} FROM ({scored_sql(policy=policy)})"))
    def per_class(spark: SparkSession, sf: str) -> DataFrame:
        pairs = M.join_truth(table(spark, sf, "results"), table(spark, sf, "manifest"))
        return rounded(M.evaluate(pairs, policy=policy), "precision", "recall", "f1")


for _policy in POLICIES:
    _per_class(_policy)


@register(
    "macro_f1",
    oracle(
        "SELECT run, round(avg(f1), 6) AS macro_f1, count(*) AS n_classes "
        f"FROM ({scored_sql()}) WHERE class <> 'any_hemorrhage' GROUP BY run"
    ),
)
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.macro_f1(M.evaluate(table(spark, sf, "pairs"))), "macro_f1")


@register(
    "parse_health",
    oracle(
        "SELECT run, count(*) AS n, count(*) FILTER (NOT parsed) AS n_failed, count(*) FILTER (refused) AS n_refused, "
        "round(avg((NOT parsed)::int), 6) AS parse_failure_rate, round(avg(refused::int), 6) AS refusal_rate FROM {results} GROUP BY run"
    ),
)
def parse_health(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.parse_health(table(spark, sf, "results")), "parse_failure_rate", "refusal_rate")


@register("method_counts", oracle("SELECT run, method, count(*) AS n FROM {results} GROUP BY run, method"))
def method_counts(spark: SparkSession, sf: str) -> DataFrame:
    return M.method_counts(table(spark, sf, "results"))


_MISSED = f"({bin_sql('any_hemorrhage')}) = 1 AND ({bin_sql('pred_any_hem')}) = 0"


@register("missed_cases", oracle(f"SELECT run, image_file FROM {{pairs}} WHERE {_MISSED}"))
def missed_cases(spark: SparkSession, sf: str) -> DataFrame:
    return M.missed_cases(table(spark, sf, "pairs")).select("run", "image_file")


MISSED_SUMMARY = (
    f"SELECT run, count(*) FILTER ({_MISSED}) AS n_missed, sum(any_hemorrhage) AS n_positive, "
    + ", ".join(f"coalesce(sum({k}) FILTER ({_MISSED}), 0) AS missed_{k}" for k in LABELS)
    + f", round(count(*) FILTER ({_MISSED}) / sum(any_hemorrhage), 6) AS missed_rate FROM {{pairs}} GROUP BY run"
)


@register("missed_summary", oracle(MISSED_SUMMARY))
def missed_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.missed_summary(table(spark, sf, "pairs")), "missed_rate")


@register(
    "manifest_summary",
    oracle(
        "SELECT count(*) AS n, count(*) FILTER (is_normal) AS n_normal, round(avg(is_normal::int), 6) AS normal_share, "
        "count(*) FILTER (NOT is_normal) AS n_positive, "
        + ", ".join(f"sum({k}) AS n_{k}" for k in LABELS)
        + ", count(DISTINCT study_id) AS distinct_study_id, count(DISTINCT patient) AS distinct_patient FROM {manifest}"
    ),
)
def manifest_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.manifest_summary(table(spark, sf, "manifest"), distinct=["study_id", "patient"]), "normal_share")


# -- intervals ----------------------------------------------------------------

_KEYED_BOOT = 200


def keyed_sql(n_boot: int, seed: int) -> str:
    """Row resampling by md5, over rows sorted by confusion cell."""
    return f"""
    cells AS (SELECT run, class, n, tp, fp, fn FROM ({counts_sql()})),
    draws AS (SELECT c.*, b.b, ('0x' || substr(md5(concat_ws('|', '{seed}', b.b, j.j)), 1, 15))::bigint % c.n AS spot
              FROM cells c, range({n_boot}) b(b), LATERAL (SELECT unnest(range(c.n)) AS j) j),
    resampled AS (SELECT run, class, b, count(*) FILTER (spot < tp) AS t, count(*) FILTER (spot >= tp AND spot < tp + fp) AS f,
                         count(*) FILTER (spot >= tp + fp AND spot < tp + fp + fn) AS m FROM draws GROUP BY run, class, b),
    scored AS (SELECT run, class, b, CASE WHEN t > 0 THEN 2 * t / (2 * t + f + m) ELSE 0 END AS f1 FROM resampled)
    """


def _chain_sql(name: str, params: str, i: int) -> str:
    """{name}: draw ``x`` of cell i for each (run, class, b), the least k whose cumulative probability reaches u; {params} has m and p."""
    logs = "lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p)"
    return f"""{name}_p AS ({params}),
    {name}_c AS (SELECT run, class, m, k, sum(CASE WHEN p <= 0 THEN (k = 0)::INT WHEN p >= 1 THEN (k = m)::INT ELSE exp({logs}) END) OVER (PARTITION BY run, class, m ORDER BY k) AS cdf
      FROM (SELECT run, class, m, p, unnest(range(m + 1)) AS k FROM (SELECT DISTINCT run, class, m, p FROM {name}_p))),
    {name} AS (SELECT q.run, q.class, q.b, q.m, coalesce(min(c.k), q.m) AS x FROM {name}_p q JOIN u ON u.run = q.run AND u.class = q.class AND u.b = q.b AND u.i = {i}
      LEFT JOIN {name}_c c ON c.run = q.run AND c.class = q.class AND c.m = q.m AND c.cdf >= u.u GROUP BY q.run, q.class, q.b, q.m)"""


def cell_ci_sql(n_boot: int, seed: int) -> str:
    """``ci`` (run, class, f1_lo, f1_hi): intervals from multinomials drawn cell by cell."""
    lo, hi = R.interval_positions(n_boot, 0.025, 0.975)
    return f"""cells AS MATERIALIZED (SELECT run, class, n, tp, fp, fn FROM ({counts_sql()})),
    u AS MATERIALIZED (SELECT run, class, b, i, ('0x' || substr(md5(concat_ws('|', '{seed}', run, class, b, i)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
      FROM cells, range({n_boot}) b(b), range(3) i(i)),
    {_chain_sql("x1", "SELECT run, class, b, n AS m, tp::DOUBLE / n AS p FROM cells, (SELECT DISTINCT b FROM u)", 0)},
    {_chain_sql("x2", "SELECT run, class, b, m - x AS m, CASE WHEN n > tp THEN fp::DOUBLE / (n - tp) ELSE 0 END AS p FROM x1 JOIN cells USING (run, class)", 1)},
    {_chain_sql("x3", "SELECT run, class, b, m - x AS m, CASE WHEN n > tp + fp THEN fn::DOUBLE / (n - tp - fp) ELSE 0 END AS p FROM x2 JOIN cells USING (run, class)", 2)},
    drawn_f1 AS (SELECT run, class, CASE WHEN x1.x > 0 THEN 2.0::DOUBLE * x1.x / (2 * x1.x + x2.x + x3.x) ELSE 0 END AS f1 FROM x1 JOIN x2 USING (run, class, b) JOIN x3 USING (run, class, b)),
    ci AS MATERIALIZED (SELECT run, class, s[{lo + 1}] AS f1_lo, s[{hi + 1}] AS f1_hi FROM (SELECT run, class, list_sort(list(f1)) AS s FROM drawn_f1 GROUP BY run, class))"""


@register("bootstrap_ci_cells", oracle(f"WITH {cell_ci_sql(_KEYED_BOOT, 42)} SELECT run, class, round(f1_lo, 6) AS f1_lo, round(f1_hi, 6) AS f1_hi FROM ci"))
def bootstrap_ci_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals whose cost goes by confusion cells, drawn alike by both engines."""
    return rounded(R.cell_ci(M.evaluate(table(spark, sf, "pairs")), n_boot=_KEYED_BOOT).select("run", "class", "f1_lo", "f1_hi"), "f1_lo", "f1_hi")


@register(
    "bootstrap_ci_keyed",
    oracle(
        f"WITH {keyed_sql(_KEYED_BOOT, 42)}, o AS (SELECT run, class, f1, row_number() OVER (PARTITION BY run, class ORDER BY f1) - 1 AS r FROM scored) "
        "SELECT run, class, round(max(f1) FILTER (r = 5), 6) AS f1_lo, round(max(f1) FILTER (r = 195), 6) AS f1_hi FROM o GROUP BY run, class"
    ),
)
def bootstrap_ci_keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Row-by-row resampling, reproducible in any engine."""
    counts = M.class_counts(table(spark, sf, "pairs"))
    draws = R.keyed_bootstrap(counts, n_boot=_KEYED_BOOT, seed=42)
    return rounded(R.keyed_ci(draws, ["run", "class"], _KEYED_BOOT), "f1_lo", "f1_hi")


# F1's standard error over resamples by the delta method, and how far a 95 % interval spans
_SPAN = "3.92 * sqrt(1.0 * tp * (fp + fn) * (tp + fp + fn)) * 2 / ((2 * tp + fp + fn) * (2 * tp + fp + fn))"


@register("bootstrap_ci", oracle(f"SELECT {_SCORE_OUT}, true AS holds_f1, true AS has_span FROM ({scored_sql()})"))
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """The default interval: multinomial draws over the confusion cells, 2000 resamples.

    Its ends come from a generator, so two statements about them are given instead: the interval holds the point,
    and with 25 hits and 25 faults or more it is as wide as the delta method says, to a fifth.
    """
    scored = R.score_with_ci(table(spark, sf, "pairs"))
    span = F.expr(_SPAN)
    few = (F.col("tp") < 25) | (F.col("fp") + F.col("fn") < 25)
    told = scored.withColumns({
        "holds_f1": F.col("f1").between(F.col("f1_lo") - 1e-12, F.col("f1_hi") + 1e-12),
        "has_span": few | (F.abs(F.col("f1_hi") - F.col("f1_lo") - span) <= 0.2 * span),
    })
    return rounded(told.drop("f1_lo", "f1_hi"), "precision", "recall", "f1")


def _run(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, "results").filter(F.col("run") == name)


@register(
    "three_way_join",
    oracle(
        "SELECT m.image_file, m.any_hemorrhage, a.pred_any_hem AS pred_a, b.pred_any_hem AS pred_b FROM {manifest} m "
        "JOIN {results} a ON a.image_file = m.image_file AND a.run = 'base' JOIN {results} b ON b.image_file = m.image_file AND b.run = 'image'"
    ),
)
def three_way_join(spark: SparkSession, sf: str) -> DataFrame:
    return R.three_way(table(spark, sf, "manifest"), _run(spark, sf, "base"), _run(spark, sf, "image"))


def _outcome_sql(pred: str) -> str:
    g, p = bin_sql("any_hemorrhage"), bin_sql(pred)
    return f"CASE WHEN ({g}) = 1 AND ({p}) = 1 THEN 'tp' WHEN ({g}) = 0 AND ({p}) = 1 THEN 'fp' WHEN ({g}) = 1 AND ({p}) = 0 THEN 'fn' ELSE 'rest' END"


@register(
    "paired_cells",
    oracle(
        f"SELECT {_outcome_sql('pa')} AS a, {_outcome_sql('pb')} AS b, count(*) AS n FROM (SELECT m.any_hemorrhage, x.pred_any_hem AS pa, y.pred_any_hem AS pb "
        "FROM {manifest} m JOIN {results} x ON x.image_file = m.image_file AND x.run = 'base' "
        "JOIN {results} y ON y.image_file = m.image_file AND y.run = 'image') GROUP BY ALL"
    ),
)
def paired_cells(spark: SparkSession, sf: str) -> DataFrame:
    pairs = R.three_way(table(spark, sf, "manifest"), _run(spark, sf, "base"), _run(spark, sf, "image"))
    return R.paired_cells(pairs, "any_hemorrhage", "pred_a", "pred_b")


def _paired_f1(pred: str) -> str:
    """F1 of one run over the paired rows."""
    tp, other = (f"count(*) FILTER (({_outcome_sql(pred)}) {test})" for test in ("= 'tp'", "IN ('fp', 'fn')"))
    return f"CASE WHEN {tp} > 0 THEN 2.0 * {tp} / (2.0 * {tp} + {other}) ELSE 0 END"


@register(
    "significance_report",
    oracle(
        "SELECT 'base' AS label_a, 'image' AS label_b, 'negative' AS uncertain_policy, n, round(a, 6) AS f1_a, round(b, 6) AS f1_b, "
        "round(b - a, 6) AS diff, true AS holds_diff, true AS agrees FROM ("
        f"SELECT count(*) AS n, {_paired_f1('pa')} AS a, {_paired_f1('pb')} AS b "
        "FROM (SELECT m.any_hemorrhage, x.pred_any_hem AS pa, y.pred_any_hem AS pb FROM {manifest} m "
        "JOIN {results} x ON x.image_file = m.image_file AND x.run = 'base' JOIN {results} y ON y.image_file = m.image_file AND y.run = 'image'))"
    ),
)
def significance_report(spark: SparkSession, sf: str) -> DataFrame:
    """Paired bootstrap of base against image, 2000 resamples, one row.

    Interval and p-value are random; stated are that the interval holds the difference, and that a p-value clearly
    below (above) one in twenty goes with an interval without (with) zero.
    """
    report = R.significance_report(
        table(spark, sf, "manifest"), _run(spark, sf, "base"), _run(spark, sf, "image"), label_a="base", label_b="image"
    )
    apart = (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)
    told = report.withColumns({
        "holds_diff": F.col("diff").between(F.col("ci_lo"), F.col("ci_hi")),
        "agrees": F.when(F.col("p_value") < 0.045, apart).when(F.col("p_value") > 0.055, ~apart).otherwise(F.lit(True)),
    })
    return rounded(told.drop("ci_lo", "ci_hi", "p_value"), "f1_a", "f1_b", "diff")


@register(
    "interval_overlaps",
    oracle(
        f"WITH {cell_ci_sql(_KEYED_BOOT, 42)} "
        "SELECT x.class, x.run AS a, y.run AS b, x.f1_lo <= y.f1_hi AND y.f1_lo <= x.f1_hi AS overlap FROM ci x JOIN ci y ON x.class = y.class AND x.run < y.run"
    ),
)
def interval_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    counts = M.class_counts(table(spark, sf, "pairs"))
    ci = R.cell_ci(counts, n_boot=_KEYED_BOOT)
    return R.interval_overlaps(ci, ["class"], "run").select("class", "a", "b", "overlap")
