"""Readers and writers: derived rows are written by Spark, read back and compared."""

from __future__ import annotations

import hashlib
import math
import uuid

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit.operators.splits import todo
from assaykit.plans.scoring import two_stage_run
from assaykit.plans.waves import score_in_waves
from assaykit.session import SHUFFLES_END, settings, shared_folder
from assaykit.sources import images as I
from assaykit.sources import labels as L
from assaykit.sources import results as R
from assaykit.streaming.incremental import score_incrementally
from suite import register
from suite.answers import PARSED
from suite.derived import LABELS, oracle, spark_sql, table
from suite.retrieval import text_top_sql

_FLAGS = ", ".join(LABELS)


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "wide_label_scan",
    oracle(f"SELECT patient, slice, {_FLAGS}, Fracture, No_Hemorrhage, any_hemorrhage, is_normal, present_subtypes FROM {{manifest}}"),
)
def wide_label_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Wide CSV whose cells read ``1.0``."""
    path = fresh(spark, "wide")
    names = {
        "patient": "PatientNumber", "slice": "SliceNumber", "IPH": "Intraparenchymal", "IVH": "Intraventricular", "SAH": "Subarachnoid",
        "EDH": "Epidural", "SDH": "Subdural", "No_Hemorrhage": "No_Hemorrhage", "Fracture": "Fracture_Yes_No",
    }
    order = ["patient", "slice", *L.WIDE_COLUMNS.values(), "No_Hemorrhage", "Fracture"]
    cells = table(spark, sf, "manifest").select(*[F.col(c).cast("double").alias(names[c]) for c in order])
    cells.filter("PatientNumber % 2 = 0").write.option("header", True).csv(path)
    # files of one folder may order their columns differently
    cells.filter("PatientNumber % 2 = 1").select(*reversed(cells.columns)).write.mode("append").option("header", True).csv(path)
    return L.read_wide_labels(spark, path)


@register(
    "long_label_scan",
    oracle(f"SELECT image_id, {_FLAGS}, any_hemorrhage, is_normal FROM {{slice_index}}"),
)
def long_label_scan(spark: SparkSession, sf: str) -> DataFrame:
    """One CSV row per (image, label), absent labels left out, the official any row ignored."""
    path = fresh(spark, "long")
    entries = F.array(
        *[F.struct(F.lit(s).alias("s"), F.col(k).alias("v")) for s, k in L.LONG_SUFFIXES.items()],
        F.struct(F.lit("any").alias("s"), F.lit(1).alias("v")),
    )
    rows = table(spark, sf, "slice_index").select("image_id", F.inline(entries)).filter((F.col("v") == 1) | (F.col("s") == "subdural"))
    rows.select(F.concat_ws("_", F.lit("ID"), "image_id", "s").alias("ID"), F.col("v").alias("Label")).write.option("header", True).csv(path)
    out = L.read_long_labels(spark, path)
    return out.select(F.substring("image_id", 4, 1000).alias("image_id"), *LABELS, "any_hemorrhage", "is_normal")


@register(
    "manifest_scan",
    oracle(f"SELECT image_file, patient, slice, any_hemorrhage, is_normal, nullif(present_subtypes, '') AS present_subtypes, {_FLAGS}, Fracture, No_Hemorrhage FROM {{manifest}}"),
)
def manifest_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest written as CSV and read with its schema; booleans come back from text, keys are checked."""
    path = fresh(spark, "manifest")
    columns = ["image_file", "patient", "slice", "any_hemorrhage", "is_normal", "present_subtypes", *LABELS, "Fracture", "No_Hemorrhage"]
    R.write_table(table(spark, sf, "manifest"), path, columns, "csv")
    return L.read_manifest(spark, path)


@register(
    "listing_parse",
    "SELECT page_id, 's' || (page_id // 7) AS study_id, 'ID_' || substr(md5(url), 1, 9) || '-b.v2' AS image_id FROM pages",
)
def listing_parse(spark: SparkSession, sf: str) -> DataFrame:
    paths = spark_sql(
        spark, sf,
        "SELECT page_id, concat('pngs/pngs/s', cast(cast(floor(page_id / 7) AS bigint) AS string), '/series', cast(page_id AS string), '/IM_0001-ID_', substr(md5(url), 1, 9), '-b.v2.png') AS path FROM {pages}",
    )
    return L.parse_listing(paths).select("page_id", "study_id", "image_id")


@register("folder_scan", oracle("SELECT study_id AS folder, 1 AS n_files, sum(strlen(d.text) + 1) AS n_bytes FROM {manifest} m JOIN {documents} d ON m.doc_id = d.doc_id GROUP BY study_id"))
def folder_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A folder tree with one file per study, listed by extension; contents are not read."""
    path = fresh(spark, "folder")
    spark_sql(spark, sf, "SELECT m.study_id, d.text FROM {manifest} m JOIN {documents} d ON m.doc_id = d.doc_id").repartition(
        "study_id"
    ).write.partitionBy("study_id").text(path)
    files = I.list_images(spark, path, ("txt",))
    folder = F.regexp_extract("path", "study_id=([^/]*)/", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


@register("image_stems", "SELECT page_id, 'p.' || page_id AS stem FROM pages")
def image_stems(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "pages").select("page_id", F.concat(F.lit("dir/p."), F.col("page_id").cast("string"), F.lit(".png")).alias("path"))
    return files.select("page_id", L.image_stem("path").alias("stem"))


@register(
    "results_last_wins",
    oracle("SELECT image_file, run, pred_any_hem FROM {results} QUALIFY row_number() OVER (PARTITION BY image_file ORDER BY CASE run WHEN 'base' THEN 1 WHEN 'text' THEN 2 ELSE 3 END DESC) = 1"),
)
def results_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines with several records per key and no order of their own; the one written last counts."""
    path = fresh(spark, "results")
    results = table(spark, sf, "results")
    for runs in ("run = 'base'", "run = 'text'", "run not in ('base', 'text')"):
        results.filter(runs).write.mode("append").json(path)
    return R.last_per_key(R.read_results(spark, path)).select("image_file", "run", "pred_any_hem")


@register("resume_keys", oracle("SELECT DISTINCT image_file FROM {results} WHERE parsed AND NOT refused"))
def resume_keys(spark: SparkSession, sf: str) -> DataFrame:
    """A log with broken lines (unparsed) and keyless lines (refused)."""
    path = fresh(spark, "log")
    whole = F.to_json(F.struct("image_file", "run"))
    line = F.when(~F.col("parsed"), F.substring(whole, 1, 20)).when(F.col("refused"), F.lit('{"run": "x"}')).otherwise(whole)
    table(spark, sf, "results").select(line.alias("value")).write.text(path)
    return R.done_keys(spark, path)


@register(
    "run_table_scan",
    oracle("SELECT r.run, coalesce(s.n, 0) AS n FROM (SELECT 'base' AS run UNION ALL SELECT 'image' UNION ALL SELECT 'later') r "
           "LEFT JOIN (SELECT run, count(*) AS n FROM {results} GROUP BY run) s ON r.run = s.run"),
)
def run_table_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Run-partitioned results against the registry; a run not there yet is told apart."""
    path = fresh(spark, "runs")
    R.write_results(table(spark, sf, "results"), path)
    registry = spark.sql("SELECT 'base' AS run UNION ALL SELECT 'image' UNION ALL SELECT 'later'")
    return R.read_run_table(spark, path, registry).groupBy("run").agg(F.count_if("found").alias("n"))


@register("index_round_trip", "SELECT vec_id, label, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def index_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark, "index")
    R.write_index(table(spark, sf, "embeddings"), path, "vec_id")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return R.read_index(spark, path).select("vec_id", "label", F.round(total, 5).alias("total"))


_SCORED = f"WITH {PARSED} SELECT image_file, any_hem AS pred_any_hem, {', '.join(f'{k} AS pred_{k}' for k in LABELS)}, refused, parsed, method FROM parsed WHERE run = 'image'"


@register(
    "resumable_scoring",
    oracle(_SCORED.replace("WHERE run = 'image'", "WHERE run = 'image' AND image_file IN (SELECT image_file FROM {results} WHERE run = 'base' AND NOT parsed)")),
)
def resumable_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Three waves, of which the second fails; the job is called again and asks only what is left.

    The scoring function returns the stored answer. Called again, it refuses images of the wave that is done.
    """
    work = table(spark, sf, "answers").filter(F.col("run") == "image").withColumnRenamed("raw_text", "stored").drop("gen_seconds", "n_tokens")
    done = table(spark, sf, "results").filter((F.col("run") == "base") & F.col("parsed"))
    left = todo(work, done)
    waves, folder = 3, fresh(spark, "waves")
    size = math.ceil(left.count() / waves)

    def make_model(broken: int | None, settled: int | None):
        def make():
            def answer(batch):
                wave = [int(hashlib.md5(f"image|{k}".encode()).hexdigest()[:3], 16) % waves for k in batch["image_file"]]
                if broken in wave:
                    raise RuntimeError("the model is gone")
                if settled in wave:
                    raise AssertionError("asked again for a wave that was done")
                return batch[["stored"]].rename(columns={"stored": "raw_text"}).assign(n_tokens=batch["stored"].str.len() // 4)

            return answer

        return make

    try:
        score_in_waves(left, make_model(1, None), "image", folder, wave_rows=size)
    except PythonException:
        pass
    out = score_in_waves(left, make_model(None, 0), "image", folder, wave_rows=size)
    return out.select("image_file", "pred_any_hem", *[f"pred_{k}" for k in LABELS], "refused", "parsed", "method")


_FAST_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


@register(
    "incremental_scoring",
    oracle(f"WITH {PARSED} SELECT CASE run WHEN 'base' THEN '007' WHEN 'image' THEN '010' ELSE run END AS run, image_file, any_hem AS pred_any_hem, {', '.join(f'{k} AS pred_{k}' for k in LABELS)}, method FROM parsed"),
)
def incremental_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Answer files through the streaming job twice, the second time with old files repeated.

    Two of the runs are named like numbers; such names stay text.
    """
    source, sink, state = (fresh(spark, n) for n in ("answers", "scored", "state"))
    number = F.when(F.col("run") == "base", "007").when(F.col("run") == "image", "010").otherwise(F.col("run")).alias("run")
    answers = table(spark, sf, "answers").select(number, "image_file", "raw_text", F.col("gen_seconds").cast("double"), "n_tokens")

    def arrive(rows: DataFrame) -> None:
        with settings(spark, SHUFFLES_END):
            rows.write.mode("append").options(**_FAST_GZIP).json(source)

    arrive(answers.filter(F.col("run") != "010"))
    score_incrementally(spark, source, sink, state).awaitTermination()
    arrive(answers.filter(F.col("run") != "007"))
    score_incrementally(spark, source, sink, state).awaitTermination()
    return R.read_runs(spark, sink).select("run", "image_file", "pred_any_hem", *[f"pred_{k}" for k in LABELS], "method")


_FINDINGS = "SELECT image_file, m.doc_id, d.text AS stored FROM {manifest} m JOIN {documents} d ON m.doc_id = d.doc_id"


@register(
    "two_stage_run",
    oracle(
        "WITH f AS (SELECT doc_id, text FROM {documents}), "
        + text_top_sql("f", "doc_id", 2)
        + ", c AS (SELECT h.query_id, string_agg(concat('- ', b.text), chr(10) ORDER BY h.rank) AS bullets FROM hits h JOIN benchmark b ON b.item_id = h.doc_id GROUP BY h.query_id) "
        "SELECT m.image_file, CASE WHEN md5(p) < '8' THEN 1 ELSE 0 END AS pred_any_hem, md5(p) AS prompt_md5, (2 * length(d.text))::int AS n_tokens FROM {manifest} m "
        "JOIN {documents} d ON d.doc_id = m.doc_id JOIN (SELECT query_id, concat('SYS', chr(10), chr(10), '" + V.TEXT_CONTEXT_HEADER + "', chr(10), bullets) AS p FROM c) c ON c.query_id = m.doc_id"
    ),
)
def two_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Findings (the stored text), retrieval, second pass; the answer depends on the prompt alone."""

    def make_findings():
        def describe(batch):
            return batch[["stored"]].rename(columns={"stored": "raw_text"}).assign(n_tokens=batch["stored"].str.len())

        return describe

    def make_answer():
        from hashlib import md5

        def answer(batch):
            digest = batch["system_prompt"].map(lambda p: md5(p.encode()).hexdigest())
            text = digest.map(lambda d: f"HEMORRHAGE: {'yes' if d < '8' else 'no'}\n{d}")
            return text.to_frame("raw_text").assign(n_tokens=batch["stored"].str.len())

        return answer

    kb = table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    out = two_stage_run(spark_sql(spark, sf, _FINDINGS), kb, make_findings, make_answer, "two", "SYS")
    return out.select("image_file", "pred_any_hem", F.substring("raw_text", -32, 32).alias("prompt_md5"), "n_tokens")
