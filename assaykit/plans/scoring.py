"""Scoring runs end to end: gated few-shot scoring and two-stage scoring.

Model calls cost far more than anything else here, so an answer that is needed twice
is written to the checkpoint folder before it is used again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit.operators.context import build_context, few_shot_messages, system_prompt, text_top_k
from assaykit.operators.scoring import ScoreFn, gate, result_records, score
from assaykit.session import cut_lineage

MakeScoreFn = Callable[[], ScoreFn]


def gated_few_shot_run(
    queries: DataFrame,
    choose: Callable[[DataFrame], DataFrame],
    pool: DataFrame,
    make_gate_fn: MakeScoreFn,
    make_score_fn: MakeScoreFn,
    run: str,
    prompt: str,
    system: str = "",
    query_id: str = "image_file",
) -> DataFrame:
    """Result records of a few-shot run in which foreign images are turned away first.

    ``choose`` maps the queries that passed to (query_id, slot, pool_id) exemplars;
    ``pool`` gives their answers (pool_id, label_text). The scoring function receives a
    ``chat`` column. Blocked queries get the refusal text and plan no retrieval.
    """
    asked = score(queries, make_gate_fn, query_id).select(query_id, F.col("raw_text").alias("gate_answer"))
    passed, blocked = gate(cut_lineage(asked))
    work = queries.join(passed.select(query_id), query_id)
    context = build_context(work.select(query_id), "image", choose(work), pool, query_id)
    chat = few_shot_messages(F.col(query_id), F.col("exemplars"), prompt, system)
    answered = score(context.select(query_id, chat.alias("chat")), make_score_fn, query_id)
    turned_away = blocked.select(
        query_id, "raw_text", F.lit(0.0).alias("gen_seconds"), F.lit(0).cast("int").alias("n_tokens")
    )
    return result_records(answered.unionByName(turned_away), run)


def two_stage_run(
    work: DataFrame,
    kb: DataFrame,
    make_findings_fn: MakeScoreFn,
    make_score_fn: MakeScoreFn,
    run: str,
    system: str,
    k: int = V.TWO_STAGE_K,
    key: str = "image_file",
    carry: tuple[str, ...] = (),
    **options,
) -> DataFrame:
    """Result records of a run whose context comes from each image's own findings.

    The first pass describes the image, the findings query the knowledge base, and the
    second pass answers under ``system`` plus that context (column ``system_prompt``).
    Seconds and tokens of both passes are added up.
    """
    first = cut_lineage(score(work, make_findings_fn, key, carry))
    findings = first.select(
        F.col(key),
        F.trim("raw_text").alias("stage1_findings"),
        F.col("gen_seconds").alias("__seconds"),
        F.col("n_tokens").alias("__tokens"),
    )
    queries = findings.select(key, F.col("stage1_findings").alias("text"))
    context = build_context(queries, "text", text_top_k(queries, kb, k, key, **options), query_id=key)
    prompts = context.select(key, system_prompt(system, F.col("context")).alias("system_prompt"))
    second = score(work.join(prompts, key), make_score_fn, key, carry)
    both = (
        second.join(findings, key)
        .withColumn("gen_seconds", F.col("gen_seconds") + F.col("__seconds"))
        .withColumn("n_tokens", F.col("n_tokens") + F.col("__tokens"))
        .drop("__seconds", "__tokens")
    )
    return result_records(both, run)
