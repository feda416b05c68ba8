"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so (after a sentence end or newline, past a minimum
length), so equal stretches of long texts give equal chunks wherever they stand. Each chunk gets an
identifier, verified once per distinct chunk; a document then is the ordered list of its chunks'
identifiers, and only these short lists are grouped and joined. Texts move once, as distinct chunks.

Defined cases: a null text is empty, and empty texts form one group; texts equal after lower-casing
A-Z only are equal; of equal texts the row with the largest doc_id stays (null is the smallest), and
of rows repeated with that doc_id one stays; an empty table gives an empty result. Other columns of
the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import ascii_lower, spread_join, stored, whole

LEAST, MOST = 1024, 8192


def chunk_list(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, in order; together they are the text."""
    cut = rf"(?s).{{{least},{most}}}?(?<=[.!?\n])|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def strong(chunk: Column) -> Column:
    return F.md5(chunk)


def ambiguous(chunks: DataFrame) -> DataFrame:
    """(digest, chunk, identifier) of distinct chunks whose digest is shared by another chunk."""
    distinct = chunks.select("digest", "chunk").distinct()
    shared = distinct.groupBy("digest").agg(F.count("*").alias("__n")).where("__n > 1").select("digest")
    return distinct.join(shared, "digest").withColumn("identifier", F.concat_ws("-", "digest", F.sha2("chunk", 256)))


def recipes(docs: DataFrame, least: int = LEAST, most: int = MOST, digest=strong) -> DataFrame:
    """(doc_id, row, recipe, text_sha256): one row per input row.

    Digests serve as identifiers where the check of all distinct chunks finds no two chunks with one
    digest. Where it finds some, these chunks get longer identifiers and the recipes that may hold
    them are made anew with those.
    """
    normal = docs.select("doc_id", ascii_lower(whole()).alias("__t"))
    cut = F.transform(chunk_list(F.col("__t"), least, most), digest)
    out = stored(
        normal.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            cut.alias("__ids"),
            F.sha2("__t", 256).alias("text_sha256"),
        ),
        "recipes",
    )
    chunks = normal.select(F.explode(chunk_list(F.col("__t"), least, most)).alias("chunk")).select(
        digest(F.col("chunk")).alias("digest"), "chunk"
    )
    doubtful = stored(ambiguous(chunks), "ambiguous")
    if not doubtful.isEmpty():
        out = _resolved(docs, out, doubtful, least, most, digest)
    return out.withColumn("recipe", F.array_join("__ids", " ")).drop("__ids")


def _resolved(docs: DataFrame, out: DataFrame, doubtful: DataFrame, least: int, most: int, digest) -> DataFrame:
    """Recipes with the longer identifiers; equal texts have one text_sha256 and so one recipe."""
    hit = out.select("text_sha256", F.explode("__ids").alias("digest")).join(doubtful.select("digest").distinct(), "digest", "left_semi")
    keys = hit.select("text_sha256").distinct()
    text = docs.select(ascii_lower(whole()).alias("__t")).withColumn("text_sha256", F.sha2("__t", 256))
    parts = (
        text.join(keys, "text_sha256", "left_semi")
        .dropDuplicates(["text_sha256"])
        .select("text_sha256", F.posexplode(chunk_list(F.col("__t"), least, most)).alias("at", "chunk"))
        .withColumn("digest", digest(F.col("chunk")))
        .join(doubtful, ["digest", "chunk"], "left")
        .groupBy("text_sha256")
        .agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("identifier", "digest").alias("id")))).alias("__l"))
        .select("text_sha256", F.col("__l.id").alias("__new"))
    )
    joined = spread_join(out, parts, "text_sha256", "left")
    return joined.withColumn("__ids", F.coalesce("__new", "__ids")).drop("__new")


def exact_groups(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, row, keep_id, group_size, kept, text_sha256): one row per input row."""
    rows = recipes(docs, **how)
    top = F.max(F.struct("doc_id", "row"))
    groups = rows.groupBy("recipe").agg(top.alias("__top"), F.count("*").alias("group_size"))
    return spread_join(rows, groups, "recipe").select(
        "doc_id",
        "row",
        F.col("__top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("__top.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row keeps; all columns stay, whatever their names."""
    rows = stored(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    key = F.struct(F.col("doc.doc_id").alias("id"), "row")
    groups = recipes(rows.select(key.alias("doc_id"), F.col("doc.text").alias("text")))
    kept = groups.groupBy("recipe").agg(F.max("doc_id").alias("top")).select(F.col("top.row").alias("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")


QUERY = "op5_exact_dedup"
SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def query(spark, sf_dir: str) -> DataFrame:
    from assaykit.llm.common import table

    return exact_groups(table(spark, sf_dir, "documents")).drop("row")
