"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources share ``factor`` times all sizes by weight; a target stops at ``most`` times its source's
size and the excess is shared again by weight until none is above. Each source is cut into blocks of documents
by hash. How many blocks a source owes the mix is split over output shards by a binary tree: every node
deals its blocks to its two halves by a multivariate hypergeometric draw, seeded by the node, so each shard finds
its counts and its place in every source's permuted blocks alone. Shards hold disjoint blocks and are
shuffled locally.

A source gives whole passes over its documents, then a part of a pass: whole blocks, and of one last
block the documents in hash order that fit, and the one that brings the sum closest to the target.

Defined cases: a null text has size 0; null is a source, the last; a source of size 0 has target 0 and its
documents are taken with their blocks at no cost; repeated rows are documents of their own; an empty table
gives an empty result. Input columns stay; the working columns' names start with two underscores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import stored, table, whole

FACTOR, MOST, WEIGHTS = 1.5, 2.0, (5.0, 2.0, 1.0)
BLOCK_WORDS, BLOCK_DOCS, SHARD_WORDS = 100_000, 10_000, 2_000_000
FILLS = 2  # passes that fill a last block
BROADCAST_BYTES = 32 << 20
DIGIT = 4096  # blocks summed together in the upper level of the running sum


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")).cast("long")


def source_targets(sizes: DataFrame, factor: float = FACTOR, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, rank, source_size, docs, target): one row per source; ``sizes`` has source and size.

    The table of sources is the recipe of the mix, one row per source however large the sources are.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    # the running number of a source needs one order of all sources: rows of the recipe, not of the corpus
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    recipe = stored(total.withColumn("rank", rank).withColumn("weight", F.get(cycle, F.col("rank") % len(weights))), "recipe")
    cap = most * F.col("source_size")
    whole_sum = recipe.agg(F.sum("source_size"), F.sum("weight")).first()
    if not whole_sum[0]:
        return recipe.withColumn("target", F.lit(0.0))
    wanted, level = factor * whole_sum[0], factor * whole_sum[0] / whole_sum[1]
    while True:
        above = cap <= F.lit(level) * F.col("weight")
        full, rest = recipe.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        if not rest:
            break
        next_level = (wanted - (full or 0.0)) / rest
        if next_level <= level:
            break
        level = next_level
    return recipe.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def shard_counts(blocks: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """How many blocks of each source a shard holds, and how many stand before them."""
    before, left, right = np.zeros_like(blocks), 0, shards
    while right - left > 1:
        middle = (left + right) // 2
        share = int(blocks.sum()) * (middle - left) // (right - left)
        rng = np.random.Generator(np.random.PCG64([seed, left, right]))
        lower = rng.multivariate_hypergeometric(blocks, share, method="marginals") if blocks.any() else np.zeros_like(blocks)
        if shard < middle:
            blocks, right = lower, middle
        else:
            before, blocks, left = before + lower, blocks - lower, middle
    return blocks, before


def _leaves(spark, blocks: list[int], shards: int, seed: int) -> DataFrame:
    """(rank, place, shard): the shard of every block place of every source."""
    quota = np.array(blocks, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf["id"]:
                count, before = shard_counts(quota, shards, int(shard), seed)
                yield pd.DataFrame({"rank": np.arange(len(quota)), "shard": shard, "first": before, "count": count})

    tree = spark.range(shards).mapInPandas(run, "rank int, shard long, first long, count long").where("count > 0")
    return tree.select("rank", "shard", F.explode(F.expr("sequence(first, first + count - 1)")).alias("place"))


def mix(
    docs: DataFrame,
    factor: float = FACTOR,
    most: float = MOST,
    weights: tuple[float, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 7,
) -> DataFrame:
    """(__row, doc_id, size, source_size, target, shards): a row per document; ``shards`` has the shard of every
    copy that the mix takes, so its length is the number of copies. ``__row`` numbers the rows of ``docs``.
    What is drawn depends on the rows' contents, not on their numbers."""
    dealt, _, planned = _planned(docs, F.monotonically_increasing_id(), factor, most, weights, block_words, shard_words, seed)
    placed = _last_block(dealt.drop("passes").join(planned, ["rank", "block"]))
    return placed.select("__row", "doc_id", "size", "source_size", "target", _shards().alias("shards"))


def _shards() -> Column:
    """The shards of a document's copies: whole passes, and the part of a pass where it is taken."""
    held = F.filter("held", lambda h: (h["pass"] < F.col("passes")) | F.col("taken"))
    return F.coalesce(F.transform(held, lambda h: h["shard"]), F.array().cast("array<long>"))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.col("blocks"))


def _planned(docs: DataFrame, row: Column, factor: float, most: float, weights: tuple[float, ...], block_words: int, shard_words: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows dealt to blocks, the recipe, and for each block the shards that hold it, pass by pass."""
    spark = docs.sparkSession
    sized = stored(docs.select(row.alias("__row"), "doc_id", "source", n_words(whole()).alias("size"), _key(seed).alias("key")), "sized")
    recipe = stored(source_targets(sized, factor, most, weights), "targets")
    blocks = F.greatest(F.ceil(F.col("source_size") / block_words), F.ceil(F.col("docs") / BLOCK_DOCS), F.lit(1))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    recipe = recipe.select(
        "source", "rank", "source_size", "target", blocks.alias("blocks"), passes.alias("passes"), (F.col("target") - passes * F.col("source_size")).alias("part")
    )
    # sources are few beside documents, but as many as the recipe has: joined, broadcast only if Spark measures them small
    dealt = stored(
        sized.alias("d")
        .join(recipe.alias("r"), F.expr("d.source <=> r.source"))
        .select(
            "__row", "doc_id", "size", "key", "rank", "source_size", "target", "blocks", "passes", "part", _block(seed).alias("block")
        ),
        "dealt",
    )
    plan = _block_plan(dealt)
    owed = plan.groupBy("rank").agg(F.max("passes").alias("p"), F.max("blocks").alias("b"), F.sum(F.col("extra").cast("long")).alias("e"))
    rows = owed.orderBy("rank").collect()  # one row per source of the recipe
    quota = [0] * (max((r["rank"] for r in rows), default=0) + 1)
    for r in rows:
        quota[r["rank"]] = int(r.p * r.b + r.e)
    words = recipe.agg(F.sum("target")).first()[0] or 0
    leaves = _leaves(spark, quota, max(1, math.ceil(words / shard_words)), seed)
    # places of a source: pass after pass over all its blocks, then the blocks of the part
    per = (
        plan.select("rank", "block", "blocks", F.explode(F.expr("sequence(0L, passes - cast(not extra as long))")).alias("pass"))
        .where("pass >= 0")
        .withColumn("place", F.col("pass") * F.col("blocks") + F.col("block"))
        .join(leaves, ["rank", "place"])
        .groupBy("rank", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("held"))
    )
    return dealt, recipe, stored(plan.select("rank", "block", "passes", "extra", "rest").join(per, ["rank", "block"], "left"), "planned")


def _block_plan(dealt: DataFrame) -> DataFrame:
    """(rank, block, blocks, passes, extra, rest): ``extra`` blocks belong to the part of a pass; of the last of
    these only documents up to ``rest`` words. Running sums go by groups of DIGIT blocks, then inside a group."""
    total = dealt.groupBy("rank", "block").agg(F.sum("size").alias("s"), *[F.max(c).alias(c) for c in ("blocks", "passes", "part")])
    total = stored(total.withColumn("digit", F.floor(F.col("block") / DIGIT)), "blocks")
    upper = total.groupBy("rank", "digit").agg(F.sum("s").alias("t"))
    before = F.sum("t").over(Window.partitionBy("rank").orderBy("digit")) - F.col("t")
    inside = F.sum("s").over(Window.partitionBy("rank", "digit").orderBy("block")) - F.col("s")
    summed = total.join(upper.select("rank", "digit", before.alias("u")), ["rank", "digit"]).withColumn("start", inside + F.col("u"))
    rest = F.col("part") - F.col("start")
    return summed.select("rank", "block", "blocks", "passes", (rest > 0).alias("extra"), F.when((rest > 0) & (rest < F.col("s")), rest).alias("rest"))


def _gaps(last: DataFrame) -> DataFrame:
    """``gap``: the words that a source's last block still owes."""
    held = F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0))
    return last.join(last.groupBy("rank").agg((F.max("rest") - held).alias("gap")), "rank")


def _last_block(placed: DataFrame) -> DataFrame:
    """``taken``: whether a document belongs to the part of a pass. Only a source's last block needs an order."""
    whole_blocks = placed.where("rest is null").withColumn("taken", F.col("extra"))
    order = Window.partitionBy("rank").orderBy("key", "doc_id", "__row")
    last = stored(placed.where("rest is not null").withColumn("taken", F.sum("size").over(order) <= F.col("rest")), "last")
    for _ in range(FILLS):  # what still fits, in the same order, past the document that did not
        last = _gaps(last)
        fits = ~F.col("taken") & (F.col("size") <= F.col("gap"))
        within = F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order) <= F.col("gap")
        last = stored(last.withColumn("taken", F.col("taken") | (fits & within)).drop("gap"), "last")
    last = _gaps(last)
    near = F.abs(F.col("gap") - F.col("size"))
    best = last.where(~F.col("taken") & (near < F.col("gap"))).groupBy("rank").agg(F.min(F.struct(near.alias("d"), "key", "__row")).alias("b"))
    best = best.select(F.col("b.__row").alias("__row"), F.lit(True).alias("more"))
    filled = last.drop("gap").join(best, "__row", "left").withColumn("taken", F.col("taken") | F.coalesce("more", F.lit(False))).drop("more")
    return whole_blocks.unionByName(filled)


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` to be broadcast if its rows are few enough; else left to the planner, which joins by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def drawn(
    docs: DataFrame, seed: int = 7, factor: float = FACTOR, most: float = MOST, weights: tuple[float, ...] = WEIGHTS,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The mix itself: the columns of ``docs`` once for every copy taken, and ``__shard``; shuffled inside each shard.

    Texts move once, to their shards. A document finds its block by its own content and the block's shards in a small table; only
    documents of a source's last block are looked up one by one. Rows are known by file and place there, so input that doesn't
    come straight from files is stored first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs, "numbered")
    row = F.struct("_metadata.file_path", "_metadata.row_index")
    dealt, recipe, planned = _planned(docs, row, factor, most, weights, block_words, shard_words, seed)
    open_ = dealt.drop("passes").join(planned.where("rest is not null"), ["rank", "block"])
    last = stored(_last_block(open_).select("__row", _shards().alias("shards")).where("size(shards) > 0"), "last-blocks")

    rows = docs.select(F.struct("*").alias("__doc"), "source", _key(seed).alias("key"), row.alias("__row"))
    sources = _small(recipe.select(F.col("source").alias("of"), "rank", "blocks"), 200)
    blocks = planned.agg(F.sum(F.coalesce(F.size("held"), F.lit(0)) + 1)).first()[0] or 0
    table_ = planned.withColumn("taken", F.col("extra")).select("rank", "block", "rest", _shards().alias("shards"))
    if blocks * 32 <= BROADCAST_BYTES:
        table_ = F.broadcast(table_)
    placed = rows.join(sources, F.expr("source <=> of")).withColumn("block", _block(seed)).join(table_, ["rank", "block"])
    sure = placed.where("rest is null").select("__doc", "key", "shards")
    looked_up = placed.where("rest is not null").drop("shards").join(last, "__row").select("__doc", "key", "shards")
    copies = sure.unionByName(looked_up).select("__doc", "key", F.posexplode("shards").alias("__copy", "__shard"))
    order = F.xxhash64(F.lit(seed), "__shard", "__copy", "key")
    return copies.withColumn("__order", order).repartition("__shard").sortWithinPartitions("__shard", "__order").select("__doc.*", "__shard")


QUERY = "op8_mixing"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.size("shards") * F.col("size")).alias("taken"))
