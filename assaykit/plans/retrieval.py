"""Exemplars for a whole sweep of settings from one pass over the pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.retrieval import contrastive_candidates, draw_random_negatives, select_contrastive
from assaykit.operators.sampling import random_per_query
from assaykit.plans.runs import RunSpec
from assaykit.session import cut_lineage


def exemplar_grid(
    queries: DataFrame,
    pool: DataFrame,
    specs: Sequence[RunSpec],
    label: str = "any_hemorrhage",
    seed: int | str = 42,
    query_id: str = "query_id",
    pool_id: str = "pool_id",
    vector: str = "embedding",
    **options,
) -> DataFrame:
    """(run, query_id, slot, pool_id) for every image setting in ``specs``.

    The nearest rows per (query, label) are found once, deep enough for the most
    demanding setting, and written to the checkpoint folder; each setting then only
    ranks that short list. Random settings draw positions and never touch the vectors.
    """
    specs = [s for s in specs if s.context == "image"]
    if not specs:
        raise ValueError("no image settings")
    depth = max(s.n_pos + s.n_neg if s.contrastive else s.k for s in specs)
    sims = None
    if any(not s.random for s in specs):
        sims = cut_lineage(contrastive_candidates(queries, pool, label, depth, 0, query_id, pool_id, vector, **options))
    nearest_first = Window.partitionBy(query_id).orderBy(F.col("sim").desc(), F.col(pool_id).asc())
    out = None
    for s in specs:
        if s.random:
            chosen = random_per_query(queries, pool, s.k, query_id, pool_id, seed).withColumnRenamed("rank", "slot")
        elif s.contrastive:
            drawn = None
            if s.random_neg and s.n_neg:
                drawn = draw_random_negatives(sims, queries, pool, label, s.n_pos, s.n_neg, seed, query_id, pool_id, vector)
            chosen = select_contrastive(sims, label, s.n_pos, s.n_neg, s.neg_position, query_id, pool_id, drawn)
        else:
            chosen = sims.withColumn("slot", F.row_number().over(nearest_first)).filter(F.col("slot") <= s.k)
        part = chosen.select(F.lit(s.run).alias("run"), query_id, F.col("slot").cast("int").alias("slot"), pool_id)
        out = part if out is None else out.unionByName(part)
    return out
