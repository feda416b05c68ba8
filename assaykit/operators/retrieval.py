"""Exemplar retrieval: plain, random and contrastive; hit rates; hardness; index checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit.functions.keyed import draw_indices
from assaykit.operators.nearest import nearest
from assaykit.operators.ordering import dense_index
from assaykit.operators.sampling import random_rows
from assaykit.session import cut_lineage

NEG_POSITIONS = ("first", "middle", "last")


def contrastive_candidates(
    queries: DataFrame, pool: DataFrame, label: str, n_pos: int = 2, n_neg: int = 1, query_id: str = "query_id",
    pool_id: str = "pool_id", vector: str = "embedding", **options,
) -> DataFrame:
    """The nearest ``n_pos + n_neg`` rows per (query, label): enough for every shortage rule.

    One more without positives, since the nearest row then takes no place.
    """
    return nearest(queries, pool, max(n_pos, 1) + n_neg, query_id, pool_id, vector, by=label, **options).drop("rank")


def select_contrastive(
    sims: DataFrame,
    label: str = "any_hemorrhage",
    n_pos: int = 2,
    n_neg: int = 1,
    neg_position: str = "last",
    query_id: str = "query_id",
    pool_id: str = "pool_id",
    random_negatives: DataFrame | None = None,
) -> DataFrame:
    """Pick positives (label of the nearest row) and negatives (any other label).

    ``sims`` holds (query_id, pool_id, sim, label), at least the nearest
    ``n_pos + n_neg`` of each label. Shortages are filled with the nearest rows not
    chosen yet, positives first. The nearest row is never a negative, also with ``n_pos=0``.
    With ``random_negatives`` (query_id, pool_id,
    draw order ``draw``, label, sim) the negatives come from there instead.

    Returns (query_id, slot, role, pool_id, sim, label), slot from 1.
    """
    if neg_position not in NEG_POSITIONS:
        raise ValueError(f"unknown negative position: {neg_position!r}")
    per_query = Window.partitionBy(query_id)
    nearest_first = per_query.orderBy(F.col("sim").desc(), F.col(pool_id).asc())
    ranked = (
        sims.select(query_id, pool_id, "sim", label)
        .withColumn("__ref", F.first(label).over(nearest_first))
        .withColumn("__same", F.col(label) == F.col("__ref"))
    )
    if n_pos == 0:
        ranked = ranked.withColumn("__first", F.row_number().over(nearest_first)).filter(F.col("__first") > 1).drop("__first")
    in_side = Window.partitionBy(query_id, "__same").orderBy(F.col("sim").desc(), F.col(pool_id).asc())
    ranked = ranked.withColumn("__side", F.row_number().over(in_side))
    hard = random_negatives is None
    is_pos = F.col("__same") & (F.col("__side") <= n_pos)
    is_neg = ~F.col("__same") & (F.col("__side") <= n_neg) if hard else F.lit(False)
    ranked = ranked.withColumn("__pick", F.when(is_pos, F.lit(0)).when(is_neg, F.lit(2)))
    spare = Window.partitionBy(query_id, F.col("__pick").isNull()).orderBy(F.col("sim").desc(), F.col(pool_id).asc())
    short_pos = F.lit(n_pos) - F.count_if(F.col("__pick") == 0).over(per_query)
    ranked = (
        ranked.withColumn("__spare", F.when(F.col("__pick").isNull(), F.row_number().over(spare)))
        .withColumn("__short", short_pos)
        # 0 positive, 1 positive taken as a fill, 2 negative, 3 negative taken as a fill
        .withColumn("__pick", F.coalesce("__pick", F.when(F.col("__spare") <= F.col("__short"), F.lit(1))))
    )
    if not hard:
        taken = ranked.select(query_id, pool_id, "__pick")
        drawn = (
            random_negatives.select(query_id, pool_id, "sim", label, "draw")
            .join(taken.filter(F.col("__pick").isNotNull()), [query_id, pool_id], "left_anti")
            .withColumn("__n", F.row_number().over(Window.partitionBy(query_id).orderBy("draw")))
            .filter(F.col("__n") <= n_neg)
        )
        # a drawn row may also be among the near ones: keep it once, as the negative
        near = ranked.join(drawn.select(query_id, pool_id), [query_id, pool_id], "left_anti")
        ranked = near.withColumn("__n", F.lit(None).cast("int")).select(
            query_id, pool_id, "sim", label, "__pick", "__n"
        ).unionByName(
            drawn.select(query_id, pool_id, "sim", label, F.lit(2).alias("__pick"), "__n")
        )
    else:
        ranked = ranked.select(query_id, pool_id, "sim", label, "__pick", F.lit(None).cast("int").alias("__n"))
    left = Window.partitionBy(query_id, F.col("__pick").isNull()).orderBy(F.col("sim").desc(), F.col(pool_id).asc())
    short_neg = F.lit(n_neg) - F.count_if(F.col("__pick") == 2).over(per_query)
    chosen = (
        ranked.withColumn("__spare", F.when(F.col("__pick").isNull(), F.row_number().over(left)))
        .withColumn("__short", short_neg)
        .withColumn("__pick", F.coalesce("__pick", F.when(F.col("__spare") <= F.col("__short"), F.lit(3))))
        .filter(F.col("__pick").isNotNull())
        .withColumn("role", F.when(F.col("__pick") <= 1, F.lit("positive")).otherwise(F.lit("negative")))
    )
    listing = per_query.orderBy("__pick", F.col("__n").asc_nulls_last(), F.col("sim").desc(), F.col(pool_id).asc())
    chosen = chosen.withColumn("slot", F.row_number().over(listing))
    if (n_pos, n_neg) == (2, 1) and neg_position != "last":
        order = {"first": F.array(F.lit(2), F.lit(3), F.lit(1)), "middle": F.array(F.lit(1), F.lit(3), F.lit(2))}
        place: Column = F.element_at(order[neg_position], F.col("slot"))
        # a shorter list closes its gaps
        chosen = chosen.withColumn("slot", F.row_number().over(per_query.orderBy(place)))
    return chosen.select(query_id, "slot", "role", pool_id, "sim", label)


def draw_random_negatives(
    sims: DataFrame,
    queries: DataFrame,
    pool: DataFrame,
    label: str,
    n_pos: int,
    n_neg: int,
    seed: int | str,
    query_id: str = "query_id",
    pool_id: str = "pool_id",
    vector: str = "embedding",
) -> DataFrame:
    """Uniform draws from the rows of another label, keyed by query: no pair scan.

    ``n_pos`` spare draws are made because a shortage of positives may already have
    used rows of the other label. Similarities are computed for the drawn rows only.
    """
    nearest_first = Window.partitionBy(query_id).orderBy(F.col("sim").desc(), F.col(pool_id).asc())
    ref = (
        sims.withColumn("__r", F.row_number().over(nearest_first))
        .filter(F.col("__r") == 1)
        .select(query_id, F.col(label).alias("__ref"))
    )
    counts = pool.groupBy(label).agg(F.count(F.lit(1)).alias("__size"))
    # classes in label order, each taking a stretch of one number line that skips the reference class
    sides = (
        ref.select("__ref").distinct().join(counts, F.col("__ref") != F.col(label))
        .withColumn("__to", F.sum("__size").over(Window.partitionBy("__ref").orderBy(label)))
        .withColumn("__from", F.col("__to") - F.col("__size"))
    )
    total = sides.groupBy("__ref").agg(F.max("__to").alias("__total"))
    draws = ref.join(total, "__ref").select(
        query_id, "__ref", F.posexplode(draw_indices(F.col("__total"), n_neg + n_pos, seed, query_id)).alias("draw", "__at")
    )
    placed = draws.join(sides, "__ref").filter(
        (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to"))
    ).select(query_id, "draw", label, (F.col("__at") - F.col("__from")).alias("__idx"))
    # ids alone are put in order; vectors are fetched for the drawn rows afterwards
    indexed = dense_index(pool.select(pool_id, label), seed, [pool_id], [label], "__idx")
    drawn = (
        placed.join(indexed, [label, "__idx"])
        .join(pool.select(pool_id, F.col(vector).alias("__pv")), pool_id)
        .join(queries.select(query_id, F.col(vector).alias("__qv")), query_id)
    )
    dot = F.aggregate(
        F.zip_with("__qv", "__pv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return drawn.select(query_id, pool_id, F.round(dot, 9).alias("sim"), label, "draw")


def contrastive(
    queries: DataFrame,
    pool: DataFrame,
    label: str = "any_hemorrhage",
    n_pos: int = 2,
    n_neg: int = 1,
    neg_position: str = "last",
    random_neg: bool = False,
    seed: int | str = 42,
    query_id: str = "query_id",
    pool_id: str = "pool_id",
    vector: str = "embedding",
    **options,
) -> DataFrame:
    """Contrastive exemplars for every query in one plan."""
    sims = contrastive_candidates(queries, pool, label, n_pos, n_neg, query_id, pool_id, vector, **options)
    negatives = None
    if random_neg and n_neg > 0:
        sims = cut_lineage(sims)  # read three times below
        negatives = draw_random_negatives(sims, queries, pool, label, n_pos, n_neg, seed, query_id, pool_id, vector)
    return select_contrastive(sims, label, n_pos, n_neg, neg_position, query_id, pool_id, negatives)


def hardness(chosen: DataFrame, query_id: str = "query_id") -> DataFrame:
    """How hard the hard negatives are: one row of similarity statistics."""
    per_query = chosen.groupBy(query_id).agg(
        F.sum(F.when(F.col("role") == "positive", F.col("sim"))).alias("__pos"),
        F.count_if(F.col("role") == "positive").alias("__n_pos"),
        F.sum(F.when(F.col("role") == "negative", F.col("sim"))).alias("__neg"),
        F.count_if(F.col("role") == "negative").alias("__n_neg"),
        (
            F.min_by("sim", F.when(F.col("role") == "positive", F.col("slot")))
            - F.min_by("sim", F.when(F.col("role") == "negative", F.col("slot")))
        ).alias("__gap"),
    )
    return per_query.agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("__pos") / F.sum("__n_pos")).alias("positive_mean"),
        (F.sum("__neg") / F.sum("__n_neg")).alias("negative_mean"),
        F.avg("__gap").alias("gap_mean"),
        F.stddev_pop("__gap").alias("gap_std"),
        F.min("__gap").alias("gap_min"),
        F.max("__gap").alias("gap_max"),
    )


def hit_rate(
    neighbours: DataFrame,
    queries: DataFrame,
    pool: DataFrame,
    k: int = V.HIT_RATE_K,
    query_id: str = "query_id",
    pool_id: str = "pool_id",
    labels: str = "labels",
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean over queries of (neighbours sharing a label) / k — k as asked, not as found.

    Queries without any neighbour count as zero. Neighbours are counted per pool row and label set of
    the query before the pool's labels are looked up, so a pool row that is near to a third of all
    queries is a row for each label set in that join.
    """
    counted = (
        neighbours.select(query_id, pool_id, *by)
        .join(queries.select(query_id, F.col(labels).alias("__ql")), query_id)
        .groupBy(pool_id, "__ql", *by)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    matched = (
        counted.join(pool.select(pool_id, F.col(labels).alias("__pl")), pool_id)
        .groupBy(*by)
        .agg(F.sum(F.when(F.arrays_overlap("__ql", "__pl"), F.col("__n")).otherwise(0)).alias("n_matched"))
    )
    if not by:
        matched = matched.withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))  # no neighbours at all
    size = queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    return matched.withColumn("n_query", size).withColumn(
        "hit_rate", F.col("n_matched") / (F.col("n_query") * F.lit(float(k)))
    )


def hit_rate_sweep(
    neighbours: DataFrame, queries: DataFrame, pool: DataFrame, ks: Sequence[int], labels: str = "labels"
) -> DataFrame:
    """(k, hit_rate, …) for several k from one list of at least ``max(ks)`` neighbours."""
    sizes = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: k >= F.col("rank"))
    spread = neighbours.select("query_id", "pool_id", F.explode(sizes).alias("k"))
    swept = hit_rate(spread, queries, pool, 1, labels=labels, by=["k"])
    return swept.withColumn("hit_rate", F.col("hit_rate") / F.col("k"))


def index_check(
    index: DataFrame, n_queries: int = 3, k: int = 3, seed: int | str = 0, key: str = "image_file",
    vector: str = "embedding", labels: str = "present_subtypes", positive: str = "any_hemorrhage",
) -> DataFrame:
    """Neighbours of a few random positives inside their own pool, with both label texts."""
    queries = random_rows(index.filter(F.col(positive) == 1).select(key, vector), n_queries, [key], seed)
    found = nearest(
        queries.withColumnRenamed(key, "query_id"), index.withColumnRenamed(key, "pool_id"), k, vector=vector,
        exclude_self=True,
    )
    text = F.when(F.col(labels) == "", F.lit("none")).otherwise(F.col(labels))
    side = index.select(F.col(key).alias("__k"), text.alias("__t"))
    return (
        found.join(side.select(F.col("__k").alias("query_id"), F.col("__t").alias("query_labels")), "query_id")
        .join(side.select(F.col("__k").alias("pool_id"), F.col("__t").alias("pool_labels")), "pool_id")
        .select("query_id", "rank", "pool_id", "sim", "query_labels", "pool_labels")
    )


def list_overlap(a: DataFrame, b: DataFrame, k: int, query_id: str = "query_id", pool_id: str = "pool_id") -> DataFrame:
    """Per query, the share of its top-k list found in another rendition's list."""
    both = a.select(query_id, pool_id).join(b.select(query_id, pool_id), [query_id, pool_id])
    shared = both.groupBy(query_id).agg(F.count(F.lit(1)).alias("n_shared"))
    return (
        a.select(query_id).distinct().join(shared, query_id, "left")
        .select(query_id, F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
        .withColumn("overlap", F.col("n_shared") / F.lit(float(k)))
    )
