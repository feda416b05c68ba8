"""Inputs derived from the given tables, as SQL text both engines read the same way.

``{name}`` stands for a given table or for another derived one. All derived tables
cover whole tables and whole texts. Variation comes from md5 of the row's key, so the
two engines see identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

LABELS = ("IPH", "IVH", "SAH", "EDH", "SDH")
RUNS = {"base": "60", "text": "30", "image": "18"}  # run -> share of flipped flags, in hex


def _listing(prefix: str, sep: str) -> str:
    return f"concat_ws('{sep}', " + ", ".join(f"CASE WHEN {prefix}{k} = 1 THEN '{k}' END" for k in LABELS) + ")"


_SUM = "IPH + IVH + SAH + EDH + SDH"

MANIFEST = f"""
SELECT f.*, CASE WHEN {_SUM} > 0 THEN 1 ELSE 0 END AS any_hemorrhage,
       {_SUM} = 0 AS is_normal, CASE WHEN {_SUM} > 0 THEN 0 ELSE 1 END AS No_Hemorrhage,
       {_listing('', '; ')} AS present_subtypes
FROM (SELECT d.doc_id, concat('img_', cast(d.doc_id AS string), '.png') AS image_file,
             cast(d.doc_id % 97 AS int) AS patient, cast(floor(d.doc_id / 97) AS int) + 1 AS slice,
             d.source AS study_id,
             coalesce(l.toxic, 0) AS IPH,
             CASE WHEN d.lang = 'de' THEN 1 ELSE 0 END AS IVH,
             1 - coalesce(l.quality, 1) AS SAH,
             CASE WHEN d.lang = 'fr' AND substr(md5(cast(d.doc_id AS string)), 1, 1) < '8' THEN 1 ELSE 0 END AS EDH,
             CASE WHEN d.source IN ('src1', 'src5', 'src9') THEN 1 ELSE 0 END AS SDH,
             CASE WHEN substr(md5(cast(d.doc_id AS string)), 2, 1) < '4' THEN 1 ELSE 0 END AS Fracture
      FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id) f
"""


def _flag(run: str, k: str, cut: str) -> str:
    return f"CASE WHEN substr(md5(concat('{run}|', m.image_file, '|{k}')), 1, 2) < '{cut}' THEN 1 - m.{k} ELSE m.{k} END"


def _drawn(run: str, cut: str) -> str:
    flags = ", ".join(f"{_flag(run, k, cut)} AS p_{k}" for k in LABELS)
    return (
        f"SELECT '{run}' AS run, m.image_file, m.doc_id, m.patient, m.slice, "
        f"md5(concat('{run}|', m.image_file)) AS h, {flags} FROM {{manifest}} m"
    )


DRAWN = " UNION ALL ".join(_drawn(r, c) for r, c in RUNS.items())

_YES = "CASE WHEN p_IPH + p_IVH + p_SAH + p_EDH + p_SDH > 0 THEN"
_LINE = f"{_YES} {_listing('p_', ', ')} ELSE 'none' END"

# Long enough to keep the document's own words out of a mention's context window.
_FILLER = "The text above came with the slice; the reading starts on the line below this one."

BODY = f"""
CASE WHEN substr(h, 1, 1) < '9' THEN
       concat('HEMORRHAGE: ', {_YES} 'yes' ELSE 'no' END, chr(10), 'SUBTYPES: ', {_LINE})
     WHEN substr(h, 1, 1) = '9' THEN
       concat('Hemorrhage - ', {_YES} 'present' ELSE 'absent' END, chr(10), 'Subtypes: possible ', {_LINE})
     WHEN substr(h, 1, 1) = 'a' AND substr(h, 2, 1) < '8' THEN
       'Possible subarachnoid hemorrhage along the left sylvian fissure. Elsewhere the study shows nothing else to report, and the convexity stays clear without epidural extension.'
     WHEN substr(h, 1, 1) = 'a' THEN
       'There is a hyperdense intraparenchymal hematoma in the right frontal lobe. No subdural collection is seen. Further down the image a Sub-Dural film is plainly visible.'
     WHEN substr(h, 1, 1) = 'b' THEN
       'HEMORRHAGE: yes. The extra-dural collection is likely acute, and the ventricles hold no intra ventricular blood.'
     WHEN substr(h, 1, 1) = 'c' THEN
       'As an AI, I cannot provide a medical diagnosis. Please consult a radiologist.'
     WHEN substr(h, 1, 1) = 'd' THEN 'No acute intracranial hemorrhage is identified.'
     WHEN substr(h, 1, 1) = 'e' THEN
       concat('<think>the epidural space looks odd</think> HEMORRHAGE: uncertain', chr(10), 'SUBTYPES: none')
     ELSE 'The image shows the brain.' END
"""

ANSWERS = f"""
SELECT r.run, r.image_file, r.patient, r.slice, concat(d.text, chr(10), '{_FILLER}', chr(10), {BODY}) AS raw_text,
       d.n_chars / 100.0 AS gen_seconds, cast(length(d.text) AS int) AS n_tokens
FROM {{drawn}} r JOIN {{documents}} d ON r.doc_id = d.doc_id
"""


def _pred(value: str, digits: int) -> str:
    """Flag with some hedges (-1) and some missing values, by a slice of the row's hash."""
    return (
        f"CASE WHEN substr(h, {digits}, 2) < '0c' THEN NULL "
        f"WHEN substr(h, {digits}, 2) < '20' THEN -1 ELSE {value} END"
    )


RESULTS = f"""
SELECT run, image_file, patient, slice,
       {_pred(_YES + " 1 ELSE 0 END", 5)} AS pred_any_hem,
       {", ".join(f"{_pred('p_' + k, 7 + 2 * i)} AS pred_{k}" for i, k in enumerate(LABELS))},
       substr(h, 17, 1) = '0' AS refused,
       substr(h, 5, 2) >= '0c' AS parsed,
       CASE WHEN substr(h, 5, 2) < '0c' THEN 'failed' WHEN substr(h, 18, 1) < '3' THEN 'fallback' ELSE 'structured' END AS method
FROM {{drawn}}
"""

# Result rows with their ground truth.
PAIRS = f"""
SELECT r.*, m.any_hemorrhage, {", ".join("m." + k for k in LABELS)}
FROM {{results}} r JOIN {{manifest}} m ON r.image_file = m.image_file
"""

# Line items as images inside studies, with five flags.
SLICES = """
SELECT concat_ws('-', cast(l_orderkey AS string), cast(l_linenumber AS string), cast(l_partkey AS string), cast(l_suppkey AS string),
                 cast(cast(round(l_extendedprice * 100) AS bigint) AS string)) AS image_id,
       cast(l_orderkey AS string) AS study_id, l_suppkey, l_partkey,
       CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 1 ELSE 0 END AS IPH,
       CASE WHEN l_linestatus = 'F' AND l_quantity > 40 THEN 1 ELSE 0 END AS IVH,
       CASE WHEN l_discount = 0 THEN 1 ELSE 0 END AS SAH,
       CASE WHEN l_tax = 0 THEN 1 ELSE 0 END AS EDH,
       CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS SDH
FROM {lineitem}
"""

SLICE_INDEX = f"""
SELECT s.*, {_SUM} = 0 AS is_normal, CASE WHEN {_SUM} > 0 THEN 1 ELSE 0 END AS any_hemorrhage FROM {{slices}} s
"""

DERIVED = {
    "manifest": MANIFEST,
    "drawn": DRAWN,
    "answers": ANSWERS,
    "results": RESULTS,
    "pairs": PAIRS,
    "slices": SLICES,
    "slice_index": SLICE_INDEX,
}


def _expand(text: str, table) -> str:
    for name in DERIVED:
        if "{" + name + "}" in text:
            text = text.replace("{" + name + "}", "(" + _expand(DERIVED[name], table) + ")")
    for name in GIVEN:
        text = text.replace("{" + name + "}", table(name))
    return text


def oracle(text: str) -> str:
    """SQL for the checking engine."""
    return _expand(text, lambda name: name)


def spark_sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    return spark.sql(_expand(text, lambda name: f"parquet.`{sf}/{name}.parquet`"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf}/{name}.parquet")
    return spark_sql(spark, sf, DERIVED[name])
