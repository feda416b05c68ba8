"""Stratified, ordered-acceptance and per-query sampling.

All draws are keyed hashes (``functions.keyed``): reruns, resumes and repartitioned
inputs give the same rows. Quotas are settled on a table of label combinations
(at most 2^L rows), never by looping over rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit import fixed_values as V
from assaykit.functions.keyed import draw_indices
from assaykit.functions.labels import present_array
from assaykit.operators.ordering import dense_index, smallest_by_hash, take_by_hash, with_hash_order
from assaykit.operators.stratify import long_list_sample
from assaykit.session import cut_lineage, shared_folder, written

SHORT_LIST = 12
_BIG = "decimal(38,0)"


def combination_quotas(
    combos: DataFrame, labels: Sequence[str], total: Column, within: Sequence[str] = (), count: str = "n", out: str = "quota"
) -> DataFrame:
    """Split ``total`` over label combinations in proportion to their counts, per ``within`` group.

    Largest remainder in exact integer arithmetic; ties go to the rarer combination,
    then to the smaller combination text. Prevalence and co-occurrence are kept to
    less than one row per combination.
    """
    everything = Window.partitionBy(*within)  # at most 2^L rows
    text = F.concat_ws("", *[F.col(k).cast("string") for k in labels])
    share = F.col("__total").cast(_BIG) * F.col(count).cast(_BIG)
    staged = (
        combos.withColumn("__all", F.sum(count).over(everything))
        .withColumn("__total", F.least(total.cast("long"), F.col("__all")))
        .withColumn("__rem", (share % F.col("__all").cast(_BIG)).cast("long"))
        .withColumn("__base", ((share - F.col("__rem")) / F.col("__all").cast(_BIG)).cast("long"))
        .withColumn("__left", F.col("__total") - F.sum("__base").over(everything))
    )
    order = everything.orderBy(F.col("__rem").desc(), F.col(count).asc(), text.asc())
    return staged.withColumn(
        out, F.col("__base") + (F.row_number().over(order) <= F.col("__left")).cast("long")
    ).drop("__all", "__total", "__rem", "__base", "__left")


def multilabel_sample(
    df: DataFrame, n: int, labels: Sequence[str], keys: Sequence[str], seed: int | str = 42
) -> DataFrame:
    """``n`` rows with the label-combination shares of the input.

    Up to SHORT_LIST labels every combination has its quota; a longer list keeps the shares of labels and of pairs.
    """
    labels = list(labels)
    if len(labels) > SHORT_LIST:
        return long_list_sample(df, n, present_array(labels), keys, seed)
    return take_by_hash(
        df, lambda combos: combination_quotas(combos, labels, F.lit(n)), labels, keys, seed, max_strata=2 ** len(labels)
    )


def enriched_sample(
    df: DataFrame,
    n: int,
    normal_frac: float,
    labels: Sequence[str] = V.SUBTYPES,
    keys: Sequence[str] = ("image_file",),
    seed: int | str = 42,
    topup: bool = True,
    normal: str = "is_normal",
) -> DataFrame:
    """A fixed share of normals, the rest positives stratified by label combination.

    With ``topup`` a shortage of positives is made up with normals; without it the
    sample is simply smaller. Row order is not part of the result.
    """
    labels = list(labels)
    want_normal = round(n * normal_frac)  # half to even
    everything = Window.partitionBy()

    def quotas(combos: DataFrame) -> DataFrame:
        sized = (
            combos.withColumn("__normals", F.coalesce(F.sum(F.when(F.col(normal), F.col("n"))).over(everything), F.lit(0)))
            .withColumn("__others", F.coalesce(F.sum(F.when(~F.col(normal), F.col("n"))).over(everything), F.lit(0)))
            .withColumn("__take_normal", F.least(F.lit(want_normal).cast("long"), F.col("__normals")))
        )
        if topup:
            sized = (
                sized.withColumn("__take_other", F.least(F.col("__others"), F.lit(n) - F.col("__take_normal")))
                .withColumn("__missing", F.lit(n) - F.col("__take_normal") - F.col("__take_other"))
                .withColumn("__take_normal", F.least(F.col("__normals"), F.col("__take_normal") + F.col("__missing")))
            )
        else:
            sized = sized.withColumn("__take_other", F.least(F.col("__others"), F.lit(n - want_normal).cast("long")))
        take = F.when(F.col(normal), F.col("__take_normal")).otherwise(F.col("__take_other"))
        return combination_quotas(sized.withColumn("__take", take), labels, F.col("__take"), within=[normal])

    return take_by_hash(df, quotas, [normal, *labels], keys, seed, max_strata=2 ** (len(labels) + 1))


def ordered_acceptance(
    candidates: DataFrame,
    available: DataFrame | Callable[[DataFrame], DataFrame],
    targets: Sequence[int],
    key: str = "image_id",
    phase: str = "phase",
    seed: int | str = 42,
    max_misses: int | None = None,
    on_stage: Callable[[int, int, int], None] | None = None,
) -> DataFrame:
    """Try candidates in keyed-hash order, phase by phase, until each target is met.

    ``phase`` holds 0, 1, …; ``targets[p]`` hits end phase p. Returns every attempted
    row with ``hit``, ``pos`` (attempt number from 0), ``streak`` (misses in a row up
    to this attempt; it runs on across phases). With ``max_misses`` the first streak
    of that length ends everything.

    Candidates are read and hashed once and stored in hash order. Ranges of hash buckets are then
    probed, as many as the hit rate so far makes likely to be enough, until the target or the miss
    streak is reached: availability is looked up for those rows only, and ranges behind the
    end are never tried. ``available`` holds the keys that are there, or is a function from a
    table of keys to those of them that are. ``on_stage`` is told (phase, rows probed, hits).

    The order is global, yet no task sees the whole list: hits, attempts and the
    place of the last hit are prefix sums in two levels (bucket totals, then rows
    inside a bucket).
    """
    spark = candidates.sparkSession
    # another seed than the one that drew the candidates: selection must not decide the order
    hashed = with_hash_order(candidates, f"{seed}-order", [key])
    listed = written(hashed.sortWithinPartitions(phase, "__bucket"), "candidates")
    sizes: dict[int, list[tuple[str, int]]] = {}
    for r in listed.groupBy(phase, "__bucket").count().orderBy(phase, "__bucket").collect():  # at most 4096 a phase
        sizes.setdefault(int(r[phase]), []).append((r["__bucket"], r["count"]))
    path = f"{shared_folder(spark)}/attempts-{uuid.uuid4().hex}"
    schema = T.StructType([*listed.schema.fields, T.StructField("hit", T.IntegerType())])

    def tried() -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    listed.limit(0).withColumn("hit", F.lit(0)).write.parquet(path)
    stop = None
    for p, target in enumerate(targets):
        at, hits, rows = 0, 0, 0
        buckets = sizes.get(p, [])
        while at < len(buckets) and hits < target and stop is None:
            want = (target - hits) * (max(rows, 1) / max(hits, 1) if rows else 1.0) * 1.2 + 50
            end, held = at, 0
            while end < len(buckets) and held < want:
                held += buckets[end][1]
                end += 1
            stage = listed.where((F.col(phase) == p) & F.col("__bucket").between(buckets[at][0], buckets[end - 1][0]))
            keys = stage.select(key)
            # the few keys of a stage go to the availability table, not the other way round
            present = available(keys) if callable(available) else available.select(key).join(keys, key)
            found = stage.join(present.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
            found.withColumn("hit", F.coalesce("__hit", F.lit(0))).drop("__hit").select(*schema.names).write.mode("append").parquet(path)
            rows += held
            new = tried().where((F.col(phase) == p) & F.col("__bucket").between(buckets[at][0], buckets[end - 1][0])).agg(F.sum("hit")).first()[0] or 0
            hits += new
            if on_stage:
                on_stage(p, held, new)
            at = end
            if max_misses is not None:
                stop = _streaks(_up_to_target(tried(), targets, phase, key), phase, key).filter(F.col("streak") >= max_misses).agg(F.min("pos")).first()[0]
    result = _streaks(cut_lineage(_up_to_target(tried(), targets, phase, key)), phase, key)
    if stop is not None:
        result = result.filter(F.col("pos") <= stop)
    return result.drop("__h", "__bucket")


def _up_to_target(tried: DataFrame, targets: Sequence[int], phase: str, key: str) -> DataFrame:
    """Attempts up to the target-th hit of their phase."""
    upto = Window.partitionBy(phase, "__bucket").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = tried.groupBy(phase, "__bucket").agg(F.sum("hit").alias("__n"))
    earlier = Window.partitionBy(phase).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    hit_offset = hits.select(phase, "__bucket", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    target = F.element_at(F.array(*[F.lit(t).cast("long") for t in targets]), F.col(phase).cast("int") + 1)
    return (
        tried.join(hit_offset, [phase, "__bucket"])
        .filter(F.col("__before") < target)
        .withColumn("__hits", F.col("__before") + F.sum("hit").over(upto))
        .filter(F.col("__hits") - F.col("hit") < target)
        .drop("__before", "__hits")
    )


def _streaks(attempted: DataFrame, phase: str, key: str) -> DataFrame:
    """Attempts with ``pos`` and ``streak`` over (phase, bucket) in order."""
    inside = Window.partitionBy(phase, "__bucket").orderBy("__h", key)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = attempted.withColumn("__row", F.row_number().over(inside))
    ahead = Window.orderBy(phase, "__bucket").rowsBetween(Window.unboundedPreceding, -1)  # bucket totals only
    totals = numbered.groupBy(phase, "__bucket").agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.when(F.col("hit") == 1, F.col("__row"))).alias("__last")
    )
    totals = totals.withColumn("__offset", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    totals = totals.withColumn(
        "__carried", F.max(F.col("__offset") + F.col("__last") - 1).over(ahead)
    ).select(phase, "__bucket", "__offset", "__carried")
    placed = numbered.join(totals, [phase, "__bucket"]).withColumn("pos", F.col("__offset") + F.col("__row") - 1)
    last_hit = F.greatest(
        F.coalesce(F.col("__carried"), F.lit(-1)),
        F.coalesce(F.max(F.when(F.col("hit") == 1, F.col("pos"))).over(upto), F.lit(-1)),
    )
    return placed.withColumn("streak", F.col("pos") - last_hit).drop("__row", "__offset", "__carried")


def acceptance_candidates(
    df: DataFrame,
    n: int,
    normal_frac: float,
    labels: Sequence[str] = V.SUBTYPES,
    key: str = "image_id",
    seed: int | str = 42,
    oversample: int = V.CANDIDATE_OVERSAMPLE,
    normal: str = "is_normal",
) -> tuple[DataFrame, list[int]]:
    """Candidates for ``ordered_acceptance``: all normals, then oversampled positives."""
    n_normal = round(n * normal_frac)
    n_other = n - n_normal
    normals = df.filter(F.col(normal)).withColumn("phase", F.lit(0))
    others = multilabel_sample(df.filter(~F.col(normal)), n_other * oversample, labels, [key], seed)
    return normals.unionByName(others.withColumn("phase", F.lit(1))), [n_normal, n_other]


def random_per_query(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    query_id: str = "query_id",
    pool_id: str = "pool_id",
    seed: int | str = 42,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``k`` random pool rows per query, keyed by the query id: (query_id, rank, pool_id, carry…).

    Positions are drawn, not ranked: the work is |queries|·k, never |queries|·|pool|.
    """
    indexed = dense_index(pool.select(pool_id, *carry), seed, [pool_id], out="__idx")
    size = pool.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = draw_indices(F.col("__n"), k, seed, query_id)
    picks = queries.withColumn("__n", size).select(query_id, F.posexplode(draws).alias("__i", "__idx"))
    return picks.join(indexed, "__idx").select(
        query_id, (F.col("__i") + 1).alias("rank"), pool_id, *carry
    )


def random_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int | str = 0) -> DataFrame:
    """``n`` random rows (all, if fewer)."""
    return smallest_by_hash(df, n, keys, seed)


def first_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    Row limits inside the window are pushed below the shuffle, so a group reaches its
    task as at most ``n`` rows per input partition.
    """
    group = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*group).orderBy(*[F.col(c) for c in order])
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of a work list (a feature of the runner: a trial run)."""
    return df.orderBy(*order).limit(n)
