"""Exclusions, availability, alignment, disjointness, fidelity, label projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.labels import answer_text, present_array, present_text, shares_label
from assaykit.operators import sampling as S
from assaykit.operators import splits as P
from assaykit.plans.runs import RunSpec, experiment_grid, resolve_mode
from assaykit.session import cut_lineage
from suite import register
from suite.derived import LABELS, oracle, spark_sql, table
from suite.sampling import _multilabel_sql

N_EVAL = 300
_EVAL = f"SELECT image_id FROM {{slices}} ORDER BY md5(concat_ws('|', '7', image_id)), image_id LIMIT {N_EVAL}"


def eval_ids(spark: SparkSession, sf: str) -> DataFrame:
    return S.random_rows(table(spark, sf, "slices").select("image_id"), N_EVAL, ["image_id"], 7)


@register("resume_work_list", oracle("SELECT m.image_file FROM {manifest} m WHERE NOT EXISTS (SELECT 1 FROM {results} r WHERE r.image_file = m.image_file AND r.run = 'base' AND r.parsed)"))
def resume_work_list(spark: SparkSession, sf: str) -> DataFrame:
    done = table(spark, sf, "results").filter((F.col("run") == "base") & F.col("parsed"))
    return P.todo(table(spark, sf, "manifest"), done).select("image_file")


_USED = "SELECT patient, slice FROM {manifest} WHERE Fracture = 1"


@register("slice_exclusion", oracle(f"SELECT m.image_file FROM {{manifest}} m LEFT JOIN ({_USED}) u ON m.patient = u.patient AND m.slice = u.slice WHERE u.patient IS NULL"))
def slice_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    return P.exclude_rows(table(spark, sf, "manifest"), spark_sql(spark, sf, _USED)).select("image_file")


@register(
    "study_exclusion",
    oracle(f"WITH s AS ({{slices}}), e AS ({_EVAL}), t AS (SELECT DISTINCT study_id FROM s WHERE image_id IN (SELECT image_id FROM e)) "
           "SELECT image_id, study_id FROM s WHERE study_id NOT IN (SELECT study_id FROM t)"),
)
def study_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    """Every image of a study holding an evaluation image leaves the pool."""
    return P.exclude_groups(table(spark, sf, "slices"), eval_ids(spark, sf)).select("image_id", "study_id")


@register(
    "split_disjointness",
    oracle(f"WITH s AS ({{slices}}), e AS ({_EVAL}), ev AS (SELECT * FROM s WHERE image_id IN (SELECT image_id FROM e)), "
           "po AS (SELECT * FROM s WHERE study_id NOT IN (SELECT study_id FROM ev)) "
           + " UNION ALL ".join(
               f"SELECT '{lv}' AS level, (SELECT count(DISTINCT {c}) FROM ev) AS n_a, (SELECT count(DISTINCT {c}) FROM po) AS n_b, "
               f"(SELECT count(*) FROM (SELECT DISTINCT {c} FROM ev INTERSECT SELECT DISTINCT {c} FROM po)) AS n_shared"
               for lv, c in (("image_id", "image_id"), ("study_id", "study_id"), ("patient", "l_suppkey")))),
)
def split_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    """Image, study and patient level: shared values of evaluation set and pool."""
    s = table(spark, sf, "slices").withColumn("patient", F.col("l_suppkey"))
    ids = cut_lineage(eval_ids(spark, sf))  # read three times
    chosen = s.join(F.broadcast(ids), "image_id", "left_semi")  # N_EVAL rows
    return P.overlap_counts(chosen, P.exclude_groups(s, ids), ["image_id", "study_id", "patient"])


@register("labelled_candidates", oracle("SELECT d.doc_id, d.source, l.quality, l.toxic FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"))
def labelled_candidates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return P.candidates(docs, table(spark, sf, "labels"), "doc_id")


@register("rendition_control", oracle("SELECT d.doc_id, l.doc_id IS NOT NULL AS found FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"))
def rendition_control(spark: SparkSession, sf: str) -> DataFrame:
    """The same ids in another rendition, with hits and misses told apart."""
    return P.split_by_presence(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@register(
    "image_presence",
    oracle("SELECT m.study_id, count(*) AS n, count(*) FILTER (l.doc_id IS NOT NULL) AS n_found FROM {manifest} m LEFT JOIN {labels} l ON m.doc_id = l.doc_id GROUP BY m.study_id"),
)
def image_presence(spark: SparkSession, sf: str) -> DataFrame:
    flagged = P.split_by_presence(table(spark, sf, "manifest"), table(spark, sf, "labels"), "doc_id")
    return flagged.groupBy("study_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("found").alias("n_found"))


# depth by patient; some volumes are missing
_VOLUMES = (
    "SELECT m.patient, cast(max(d.n_chars) % 12 AS int) AS n_slices FROM {manifest} m JOIN {documents} d ON m.doc_id = d.doc_id "
    "GROUP BY m.patient HAVING substr(md5(cast(m.patient AS string)), 1, 1) < 'd'"
)


@register(
    "valid_slices",
    oracle(f"SELECT m.image_file, coalesce(m.slice >= 1 AND m.slice <= v.n_slices, false) AS valid FROM {{manifest}} m LEFT JOIN ({_VOLUMES}) v ON m.patient = v.patient"),
)
def valid_slices(spark: SparkSession, sf: str) -> DataFrame:
    """One-based slice numbers against volume depths; some volumes do not exist."""
    return P.valid_slices(table(spark, sf, "manifest"), spark_sql(spark, sf, _VOLUMES)).select("image_file", "valid")


@register(
    "align_sources",
    oracle("SELECT image_file, patient, any_hemorrhage, Fracture, No_Hemorrhage FROM {manifest} UNION ALL "
           "SELECT image_id, NULL, any_hemorrhage, NULL, 1 - any_hemorrhage FROM {slice_index}"),
)
def align_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Two sources under one schema; absent fields are null, not made up."""
    a = table(spark, sf, "manifest").select("image_file", "patient", "any_hemorrhage", "Fracture", "No_Hemorrhage")
    b = table(spark, sf, "slice_index").select(F.col("image_id").alias("image_file"), "any_hemorrhage")
    return P.align_sources(a, b).select("image_file", "patient", "any_hemorrhage", "Fracture", "No_Hemorrhage")


_GRID = [
    RunSpec("none"),
    RunSpec("text", context="text", k=5),
    RunSpec("image", context="image", k=3),
    RunSpec("contrast", context="image", contrastive=True, neg_position="first"),
]


@register(
    "experiment_grid",
    oracle(" UNION ALL ".join(
        f"SELECT image_file, '{s.run}' AS run, '{s.context}' AS context, {s.k} AS k, {str(s.contrastive).lower()} AS contrastive, "
        f"'{s.neg_position}' AS neg_position FROM {{manifest}}" for s in _GRID)),
)
def grid(spark: SparkSession, sf: str) -> DataFrame:
    return experiment_grid(table(spark, sf, "manifest").select("image_file"), _GRID).select(
        "image_file", "run", "context", "k", "contrastive", "neg_position"
    )


# flags of two settings, as a launcher passes them; null means that the flag isn't given
_MODES = [(two, image) for two in (None, False, True) for image in (None, False, True)]


def _mode_sql(default_image: bool) -> str:
    flag = lambda v: "NULL::BOOLEAN" if v is None else str(v).lower()
    rows = " UNION ALL ".join(f"SELECT {flag(two)} AS two, {flag(image)} AS image" for two, image in _MODES)
    kept = f"SELECT two, image, coalesce(two, false) AS t, coalesce(image, {str(default_image).lower()}) AS i FROM ({rows})"
    named = f"SELECT two, image, CASE WHEN i THEN 'image' WHEN t THEN 'text-twostage' ELSE 'none' END AS context FROM ({kept}) WHERE NOT (t AND i)"
    return (
        "SELECT m.image_file, g.context || '-' || coalesce(g.two::VARCHAR, 'unset') || '-' || coalesce(g.image::VARCHAR, 'unset') AS run, g.context, "
        f"(SELECT count(*) FROM ({kept}) WHERE t AND i) AS n_rejected FROM {{manifest}} m, ({named}) g"
    )


@register("mode_grid", oracle(_mode_sql(True)))
def mode_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every image under every setting that two flags with defaults allow; settings with both are rejected and counted."""
    specs, rejected = [], 0
    for two, image in _MODES:
        try:
            mode = resolve_mode(two, image, default_image=True)
        except ValueError:
            rejected += 1
            continue
        names = ["unset" if v is None else str(v).lower() for v in (two, image)]
        specs.append(RunSpec("-".join([mode, *names]), context=mode))
    grid_ = experiment_grid(table(spark, sf, "manifest").select("image_file"), specs)
    return grid_.select("image_file", "run", "context", F.lit(rejected).alias("n_rejected"))


@register(
    "label_sets",
    oracle("SELECT image_file, present_subtypes, replace(present_subtypes, '; ', '|') AS label_set, "
           "len(list_intersect(string_split(present_subtypes, '; '), ['IPH', 'SDH'])) > 0 AS shares FROM {manifest} WHERE any_hemorrhage = 1"),
)
def label_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Positives only, as packed text and as set, with an overlap test."""
    m = table(spark, sf, "manifest").filter(F.col("any_hemorrhage") == 1)
    return m.select(
        "image_file",
        present_text(LABELS).alias("present_subtypes"),
        F.array_join(present_array(LABELS), "|").alias("label_set"),
        shares_label(present_array(LABELS), F.array(F.lit("IPH"), F.lit("SDH"))).alias("shares"),
    )


@register(
    "answer_grammar",
    oracle("SELECT image_id, CASE WHEN any_hemorrhage = 0 THEN concat('HEMORRHAGE: no', chr(10), 'SUBTYPES: none') ELSE concat('HEMORRHAGE: yes', chr(10), 'SUBTYPES: ', "
           "concat_ws(', ', " + ", ".join(f"CASE WHEN {k} = 1 THEN '{k}' END" for k in LABELS) + ")) END AS label_text FROM {slice_index}"),
)
def answer_grammar(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "slice_index").select("image_id", answer_text(LABELS).alias("label_text"))


_COMBO = " || ".join(LABELS)


@register(
    "sample_fidelity",
    oracle(f"WITH pop AS ({{slice_index}}), smp AS ({_multilabel_sql('pop', 3000)}), "
           f"s AS (SELECT {_COMBO} AS c, count(*) / (SELECT count(*) FROM smp) AS x FROM smp GROUP BY c), "
           f"p AS (SELECT {_COMBO} AS c, count(*) / (SELECT count(*) FROM pop) AS x FROM pop GROUP BY c), "
           "j AS (SELECT coalesce(s.c, p.c) AS c, coalesce(s.x, 0) AS sx, coalesce(p.x, 0) AS px FROM s FULL JOIN p ON s.c = p.c) "
           "SELECT round(sum(abs(sx - px)) / 2, 6) AS total_variation, round(sum(sx) FILTER (length(replace(c, '0', '')) > 1), 6) AS sample_multi_share, "
           "round(sum(px) FILTER (length(replace(c, '0', '')) > 1), 6) AS population_multi_share, count(*) AS n_combinations FROM j"),
)
def sample_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    pop = table(spark, sf, "slice_index")
    out = P.fidelity(S.multilabel_sample(pop, 3000, LABELS, ["image_id"]), pop, LABELS)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns if c != "n_combinations"], "n_combinations")


@register(
    "label_prevalence",
    oracle(" UNION ALL ".join(f"SELECT '{k}' AS class, count(*) AS n, sum({k}) AS positives, round(sum({k}) / count(*), 6) AS share FROM {{slice_index}}" for k in LABELS)),
)
def label_prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return P.label_prevalence(table(spark, sf, "slice_index"), LABELS).withColumn("share", F.round("share", 6))
