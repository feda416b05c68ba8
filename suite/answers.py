"""Answer parsing: verdict and label lines, prose, refusals, response classes, gate, think blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit.functions import answers as A
from assaykit.operators.scoring import gate
from suite import register
from suite.derived import LABELS, oracle, table


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rx(pattern: str) -> str:
    return _lit("(?i)" + pattern)


_LINES = f"""
SELECT run, image_file, raw_text AS t,
       CASE WHEN regexp_matches(v, {_lit('^' + V.UNCERTAIN_WORDS)}) THEN -1
            WHEN regexp_matches(v, {_lit('^' + V.POSITIVE_WORDS)}) THEN 1
            WHEN regexp_matches(v, {_lit('^' + V.NEGATIVE_WORDS)}) THEN 0 END AS hem,
       CASE WHEN regexp_matches(raw_text, {_rx(V.SUBTYPES_LINE)})
            THEN trim(regexp_extract(raw_text, {_rx(V.SUBTYPES_LINE)}, 1)) END AS line,
       regexp_matches(raw_text, {_rx(V.REFUSAL)}) AS refused
FROM (SELECT *, lower(trim(regexp_extract(raw_text, {_rx(V.VERDICT_LINE)}, 1))) AS v FROM {{answers}})
"""


def _mentions_sql() -> str:
    parts = []
    for k, p in V.SUBTYPE_PATTERNS.items():
        parts.append(
            f"SELECT run, image_file, t, '{k}' AS k, regexp_extract_all(t, {_rx(p)}, 0) AS hits, "
            f"string_split_regex(t, {_rx(p)}) AS gaps FROM lines WHERE regexp_matches(t, {_rx(p)})"
        )
    return " UNION ALL ".join(parts)


PARSED = f"""
lines AS MATERIALIZED ({_LINES}),
hits AS ({_mentions_sql()}),
places AS (
  SELECT run, image_file, k, t, i,
         list_sum(list_transform(gaps[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda s: length(s))), 0) AS b,
         length(hits[i]) AS n
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM hits)),
windows AS (
  SELECT run, image_file, k, i,
         substr(t, (greatest(b - {V.CONTEXT_BEFORE}, 0) + 1)::bigint, (b + n + {V.CONTEXT_AFTER} - greatest(b - {V.CONTEXT_BEFORE}, 0))::bigint) AS around,
         substr(t, (greatest(b - {V.CONTEXT_BEFORE}, 0) + 1)::bigint, (b + {V.NEGATION_REACH} - greatest(b - {V.CONTEXT_BEFORE}, 0))::bigint) AS before
  FROM places),
readings AS (
  SELECT run, image_file, k, i,
         CASE WHEN regexp_matches(before, {_rx(V.NEGATION)}) THEN 0
              WHEN regexp_matches(around, {_rx(V.HEDGE)}) THEN -1 ELSE 1 END AS r
  FROM windows),
decided AS (
  SELECT run, image_file, k, coalesce(arg_min(r, i) FILTER (r <> 0), 0) AS r FROM readings GROUP BY ALL),
scans AS (
  SELECT l.*, {", ".join(f"max(d.r) FILTER (d.k = '{k}') AS s_{k}" for k in LABELS)}
  FROM lines l LEFT JOIN decided d ON l.run = d.run AND l.image_file = d.image_file
  GROUP BY ALL),
kinds AS (
  SELECT *, coalesce({" OR ".join(f"coalesce(s_{k} = 1, false)" for k in LABELS)}) AS pos,
         coalesce({" OR ".join(f"coalesce(s_{k} = -1, false)" for k in LABELS)}) AS unc,
         regexp_matches(t, {_rx(V.GLOBAL_NEGATIVE)}) AS neg,
         coalesce(regexp_matches(line, {_rx(V.HEDGE)}), false) AS hedged
  FROM scans),
parsed AS (
  SELECT run, image_file,
         CASE WHEN hem IS NOT NULL THEN hem WHEN pos THEN 1 WHEN unc THEN -1 WHEN neg AND NOT refused THEN 0 END AS any_hem,
         {", ".join(
             f"CASE WHEN hem = 0 THEN 0 WHEN hem IS NOT NULL AND line IS NOT NULL THEN "
             f"CASE WHEN regexp_matches(line, {_rx(V.SUBTYPE_PATTERNS[k])}) THEN CASE WHEN hedged THEN -1 ELSE 1 END ELSE 0 END "
             f"WHEN hem IS NOT NULL OR pos OR unc THEN s_{k} WHEN neg AND NOT refused THEN 0 END AS {k}" for k in LABELS)},
         refused,
         hem IS NOT NULL OR pos OR unc OR (neg AND NOT refused) AS parsed,
         CASE WHEN hem IS NOT NULL THEN 'structured' WHEN pos OR unc OR (neg AND NOT refused) THEN 'fallback' ELSE 'failed' END AS method
  FROM kinds)
"""


@register("parse_answers", oracle(f"WITH {PARSED} SELECT * FROM parsed"))
def parse_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict line, label line, prose scan, refusal and combined parse of whole texts."""
    parsed = A.parse(table(spark, sf, "answers"), "raw_text")
    return parsed.select("run", "image_file", "any_hem", *LABELS, "refused", "parsed", "method")


@register("verdict_lines", oracle(f"WITH lines AS ({_LINES}) SELECT run, image_file, hem, line, refused FROM lines"))
def verdict_lines(spark: SparkSession, sf: str) -> DataFrame:
    t, low, odd = F.col("t"), F.col("low"), F.col("odd")
    answers = table(spark, sf, "answers").withColumn("t", A.strip(F.col("raw_text")))
    answers = answers.withColumn("low", F.lower(t)).withColumn("odd", A.folding(t))
    return answers.select(
        "run", "image_file", A.verdict(t, low, odd).alias("hem"), A.subtypes_line(t, low, odd).alias("line"), A.refused(t, low, odd).alias("refused")
    )


@register(
    "prose_mentions",
    oracle(f"WITH {PARSED} SELECT run, image_file, {', '.join(f's_{k} AS {k}' for k in LABELS)} FROM scans"),
)
def prose_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Prose reading of every label on every whole text, whatever its structure."""
    t, low, odd = F.col("raw_text"), F.col("low"), F.col("odd")
    answers = table(spark, sf, "answers").withColumn("low", F.lower(t)).withColumn("odd", A.folding(t))
    parts = answers.withColumns({f"part_{k}": A.tail(t, low, odd, A.BEGINNINGS[k]) for k in V.SUBTYPE_PATTERNS})
    return parts.select(
        "run", "image_file", *[A.scan_mentions(F.col(f"part_{k}"), p).alias(k) for k, p in V.SUBTYPE_PATTERNS.items()]
    )


# Reports: the document text with sections and markers set by the row's hash.
_REPORT = (
    "concat(text, chr(10), "
    "CASE WHEN substr(md5(concat('report|', cast(doc_id AS string))), 1, 1) < '2' THEN 'The upload does not comply with head CT imaging standards.' "
    "WHEN substr(md5(concat('report|', cast(doc_id AS string))), 1, 1) < '3' THEN 'Image clarity is insufficient.' "
    "WHEN substr(md5(concat('report|', cast(doc_id AS string))), 1, 1) < '4' THEN '[Error] Objective Findings and Impression withheld.' "
    "WHEN substr(md5(concat('report|', cast(doc_id AS string))), 1, 1) < '7' THEN 'This image is not a head CT. Impression: none.' "
    "ELSE concat('Objective Findings', chr(10), 'Impression', chr(10), 'Recommendations') END)"
)
REPORTS = f"SELECT doc_id, {_REPORT} AS raw_text FROM {{documents}}"

CLASS_SQL = (
    f"CASE WHEN contains(raw_text, {_lit(V.MODALITY_REFUSAL)}) THEN 'refused_modality' "
    f"WHEN contains(raw_text, {_lit(V.QUALITY_REFUSAL)}) THEN 'refused_quality' "
    f"WHEN contains(raw_text, {_lit(V.ERROR_TAG)}) THEN 'refused_other' "
    "WHEN " + " + ".join(f"contains(raw_text, {_lit(s)})::int" for s in V.REPORT_SECTIONS) + " < 2 THEN 'refused_other' "
    "ELSE 'answered' END"
)


@register("response_classes", oracle(f"SELECT doc_id, {CLASS_SQL} AS label FROM ({REPORTS})"))
def response_classes(spark: SparkSession, sf: str) -> DataFrame:
    from suite.derived import spark_sql

    return spark_sql(spark, sf, REPORTS).select("doc_id", A.response_class(F.col("raw_text")).alias("label"))


_THOUGHTS = (
    "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN concat('  <think>', text, '</think> ', chr(10), text, ' <think>x</think> ') "
    "ELSE concat(text, ' ') END AS raw FROM {conversations}"
)


@register(
    "strip_thinking",
    oracle(
        "SELECT conv_id, turn, md5(regexp_replace(regexp_replace(raw, '(?s)<think>.*?</think>\\s*', ''), "
        "'^[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]+|[\\s\\x{00a0}\\x{2000}-\\x{200a}\\x{3000}]+$', '', 'g')) AS text_md5, "
        "contains(raw, '<think>') AS had_block FROM (" + _THOUGHTS.replace("{conversations}", "conversations") + ")"
    ),
)
def strip_thinking(spark: SparkSession, sf: str) -> DataFrame:
    from suite.derived import spark_sql

    return spark_sql(spark, sf, _THOUGHTS).select(
        "conv_id", "turn", F.md5(A.strip_thinking(F.col("raw"))).alias("text_md5"), F.col("raw").contains("<think>").alias("had_block")
    )


GATE_ANSWERS = (
    "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'answer' ELSE 'refuse' END AS expected, "
    "CASE WHEN substr(md5(concat('gate|', cast(conv_id AS string), '|', cast(turn AS string))), 1, 1) < '5' THEN concat('  No, ', text) "
    "WHEN substr(md5(concat('gate|', cast(conv_id AS string), '|', cast(turn AS string))), 1, 1) < '6' THEN NULL "
    "WHEN substr(md5(concat('gate|', cast(conv_id AS string), '|', cast(turn AS string))), 1, 1) < 'b' THEN 'Yes, this is a head CT.' "
    "ELSE text END AS answer FROM {conversations}"
)
_PASS_SQL = "coalesce(NOT starts_with(upper(trim(answer)), 'NO'), true)"


@register(
    "gate_split",
    oracle(
        f"SELECT conv_id, turn, {_PASS_SQL} AS passed, "
        f"CASE WHEN NOT {_PASS_SQL} THEN {_lit(V.GATE_REFUSAL_TEXT)} END AS raw_text FROM ({GATE_ANSWERS})"
    ),
)
def gate_split(spark: SparkSession, sf: str) -> DataFrame:
    """Both branches of the gate, put together again to be compared."""
    from suite.derived import spark_sql

    passed, blocked = gate(spark_sql(spark, sf, GATE_ANSWERS), "answer")
    return (
        passed.select("conv_id", "turn", F.lit(True).alias("passed"), F.lit(None).cast("string").alias("raw_text"))
        .unionByName(blocked.select("conv_id", "turn", F.lit(False).alias("passed"), "raw_text"))
    )
