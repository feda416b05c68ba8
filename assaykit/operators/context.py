"""Context and prompt assembly from retrieved exemplars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit.operators.nearest import nearest
from assaykit.operators.text import DIM, encode

PROVIDERS = ("none", "text", "image")


def text_top_k(
    queries: DataFrame, kb: DataFrame, k: int = V.TEXT_K, query_id: str = "query_id", doc_id: str = "doc_id",
    text: str = "text", vector: str | None = None, **options,
) -> DataFrame:
    """Nearest knowledge-base documents per query text.

    ``vector`` names a column both sides already carry; without it both are encoded here.
    """
    q, d = queries, kb
    if vector is None:
        vector = "__vec"
        q, d = encode(queries, text, vector), encode(kb, text, vector)
        options = {"dim": DIM, **options}
    found = nearest(q, d, k, query_id, doc_id, vector, **options)
    return found.join(kb.select(doc_id, F.col(text).alias("doc_text")), doc_id)


def text_context(hits: DataFrame, query_id: str = "query_id", header: str = V.TEXT_CONTEXT_HEADER) -> DataFrame:
    """(query_id, context): the header and one bullet per document, nearest first.

    A group is one query's k documents, so the list is bounded by k.
    """
    docs = F.array_sort(F.collect_list(F.struct("rank", "doc_text")))
    bullets = F.array_join(F.transform(docs, lambda d: F.concat(F.lit("- "), d["doc_text"])), "\n")
    return hits.groupBy(query_id).agg(F.concat(F.lit(header + "\n"), bullets).alias("context"))


def exemplar_lists(chosen: DataFrame, pool: DataFrame, slot: str = "slot", query_id: str = "query_id", pool_id: str = "pool_id", answer: str = "label_text") -> DataFrame:
    """(query_id, exemplars): ordered array of (slot, image, answer text); k entries per query."""
    rows = chosen.select(query_id, pool_id, F.col(slot).alias("slot")).join(pool.select(pool_id, answer), pool_id)
    items = F.array_sort(F.collect_list(F.struct("slot", F.col(pool_id).alias("image_file"), F.col(answer).alias("label_text"))))
    return rows.groupBy(query_id).agg(items.alias("exemplars"))


def build_context(
    queries: DataFrame,
    provider: str,
    hits: DataFrame | None = None,
    pool: DataFrame | None = None,
    query_id: str = "query_id",
) -> DataFrame:
    """Append the provider's context to every query.

    none -> empty ``context``; text -> ``context`` from document hits; image ->
    ``exemplars`` from chosen pool rows. Queries without hits get an empty value.
    """
    if provider not in PROVIDERS:
        raise ValueError(f"unknown context provider: {provider!r}")
    if provider == "none":
        return queries.withColumn("context", F.lit(""))
    if hits is None:
        raise ValueError(f"provider {provider!r} needs retrieval results")
    if provider == "text":
        joined = queries.join(text_context(hits, query_id), query_id, "left")
        return joined.withColumn("context", F.coalesce("context", F.lit("")))
    if pool is None:
        raise ValueError("provider 'image' needs the pool")
    lists = exemplar_lists(hits, pool, query_id=query_id)
    empty = F.array().cast(lists.schema["exemplars"].dataType)
    return queries.join(lists, query_id, "left").withColumn("exemplars", F.coalesce("exemplars", empty))


def system_prompt(base: str, context: Column) -> Column:
    """The base prompt, then the context after a blank line if there is any."""
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit(base)).otherwise(F.concat(F.lit(base + "\n\n"), context))


def _part(kind: str, text: Column, image: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"), image.cast("string").alias("image"))


def few_shot_messages(image: Column, exemplars: Column, prompt: str, system: str | Column = "") -> Column:
    """Chat messages: system, one user / assistant pair per exemplar, then the query."""
    none = F.lit(None)

    def message(role: str, *parts: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))

    def ask(img: Column) -> Column:
        return message("user", _part("image", none, img), _part("text", F.lit(prompt), none))

    shots = F.flatten(
        F.transform(
            exemplars,
            lambda e: F.array(ask(e["image_file"]), message("assistant", _part("text", e["label_text"], none))),
        )
    )
    sys_text = system if isinstance(system, Column) else F.lit(system)
    head = F.array(message("system", _part("text", sys_text, none)))
    head = F.filter(head, lambda _: sys_text != "")
    return F.concat(head, shots, F.array(ask(image)))


def two_stage_context(
    findings: DataFrame, kb: DataFrame, k: int = V.TWO_STAGE_K, query_id: str = "query_id", text: str = "stage1_findings", **options
) -> DataFrame:
    """Each image's own first-pass findings query the knowledge base."""
    queries = findings.withColumn("text", F.trim(F.col(text)))
    hits = text_top_k(queries, kb, k, query_id, **options)
    return build_context(findings, "text", hits, query_id=query_id)
