"""Stratified samples, ordered acceptance, first cases; line items stand in for images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import sampling as S
from assaykit.operators.stratify import long_list_sample as long_list
from assaykit.session import written
from suite import register
from suite.derived import LABELS, oracle, spark_sql, table

_FLAGS = ", ".join(LABELS)
_TEXT = " || ".join(LABELS)


def quota_sql(source: str, total: str, extra: str = "") -> str:
    """Largest-remainder quotas of ``total`` over label combinations in ``source``."""
    return f"""SELECT {extra}{_FLAGS}, base + (row_number() OVER (ORDER BY rem DESC, n ASC, {_TEXT} ASC) <= t - sum(base) OVER ())::bigint AS quota FROM (
    SELECT *, (t * n) // c AS base, (t * n) % c AS rem FROM (
    SELECT *, least({total}, c) AS t FROM (SELECT {extra}{_FLAGS}, count(*) AS n, (sum(count(*)) OVER ())::bigint AS c FROM {source} GROUP BY ALL)))"""


def hash_rank(strata: str, key: str = "image_id", seed: str = "42") -> str:
    return f"row_number() OVER (PARTITION BY {strata} ORDER BY md5(concat_ws('|', '{seed}', {key})), {key})"


def _multilabel_sql(source: str, n: int) -> str:
    same = " AND ".join(f"p.{k} = q.{k}" for k in LABELS)
    return f"""SELECT p.* EXCLUDE (r) FROM (SELECT *, {hash_rank(_FLAGS)} AS r FROM {source}) p
    JOIN ({quota_sql(source, str(n))}) q ON {same} WHERE p.r <= q.quota"""


_OUT = f"image_id, {_FLAGS}"


@register("multilabel_sample", oracle(f"WITH pop AS ({{slice_index}}) SELECT {_OUT} FROM ({_multilabel_sql('pop', 3000)})"))
def multilabel_sample(spark: SparkSession, sf: str) -> DataFrame:
    """3000 of all line items with the population's label-combination shares."""
    pop = table(spark, sf, "slice_index")
    return S.multilabel_sample(pop, 3000, LABELS, ["image_id"]).select("image_id", *LABELS)


# Orders as images, and the parts in them as up to 300 labels; nearly every order has a combination of its own.
_MARKED = "SELECT l_orderkey, array_sort(collect_set(concat('p', cast(l_partkey % 300 AS string)))) AS marks FROM {lineitem} GROUP BY l_orderkey"


@register("long_list_sample", "SELECT 'p' || (l_partkey % 300) AS label, count(DISTINCT l_orderkey) AS n, true AS near FROM lineitem GROUP BY ALL")
def long_list_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of all orders with the shares of 300 labels and their pairs: per label its rows, and whether those taken are near its share.

    Which rows are taken SQL can't say; near is within two rows, or within a tenth of the share where that is more (several blocks). Tests look closer.
    """
    # the orders are put together once: counts, combinations, buckets and the sample all start from the stored rows
    rows = written(spark_sql(spark, sf, _MARKED), "marked-orders")
    total = rows.count()
    n = total // 10
    taken = long_list(rows, n, "marks", ["l_orderkey"]).select(F.explode("marks").alias("label"), F.lit(1).alias("taken"))
    every = rows.select(F.explode("marks").alias("label"), F.lit(0).alias("taken")).unionByName(taken)
    counts = every.groupBy("label").agg(F.count_if(F.col("taken") == 0).alias("n"), F.sum("taken").alias("taken"))
    share = F.col("n") * n / total
    return counts.select("label", "n", (F.abs(F.col("taken") - share) <= F.greatest(F.lit(2.0), share / 10)).alias("near"))


def _enriched_sql(n: int, frac: float, topup: bool) -> str:
    want = round(n * frac)
    if topup:
        take_other = f"least(nh, {n} - least({want}, nn))"
        take_normal = f"least(nn, least({want}, nn) + {n} - least({want}, nn) - {take_other})"
    else:
        take_other, take_normal = f"least(nh, {n - want})", f"least(nn, {want})"
    same = " AND ".join(f"p.{k} = q.{k}" for k in LABELS)
    return f"""WITH pop AS ({{slice_index}}),
    sizes AS (SELECT count(*) FILTER (is_normal) AS nn, count(*) FILTER (NOT is_normal) AS nh FROM pop),
    q AS (SELECT * FROM ({quota_sql('(SELECT * FROM pop WHERE is_normal)', f'(SELECT {take_normal} FROM sizes)', 'is_normal, ')})
          UNION ALL SELECT * FROM ({quota_sql('(SELECT * FROM pop WHERE NOT is_normal)', f'(SELECT {take_other} FROM sizes)', 'is_normal, ')}))
    SELECT p.image_id, p.is_normal, {", ".join("p." + k for k in LABELS)} FROM (SELECT *, {hash_rank('is_normal, ' + _FLAGS)} AS r FROM pop) p
    JOIN q ON p.is_normal = q.is_normal AND {same} WHERE p.r <= q.quota"""


def _enriched(name: str, n: int, frac: float, topup: bool) -> None:
    @register(name, oracle(_enriched_sql(n, frac, topup)))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        pop = table(spark, sf, "slice_index")
        out = S.enriched_sample(pop, n, frac, LABELS, ["image_id"], topup=topup)
        return out.select("image_id", "is_normal", *LABELS)


_enriched("enriched_sample", 5001, 0.3, True)
_enriched("enriched_sample_topup", 50_000, 0.3, True)
_enriched("enriched_sample_no_topup", 50_000, 0.3, False)


def _acceptance_sql(n: int, frac: float, share: str, max_misses: int | None) -> str:
    n0 = round(n * frac)
    stop = f"WHERE pos <= coalesce((SELECT min(pos) FROM streaks WHERE streak >= {max_misses}), pos)" if max_misses else ""
    return f"""WITH pop AS ({{slice_index}}),
    other AS (SELECT * FROM pop WHERE NOT is_normal),
    cand AS (SELECT image_id, 0 AS phase FROM pop WHERE is_normal UNION ALL SELECT image_id, 1 FROM ({_multilabel_sql('other', (n - n0) * 2)})),
    tried AS (SELECT *, md5(concat_ws('|', '42-order', image_id)) AS h, (substr(md5(concat('available|', image_id)), 1, 1) < '{share}')::int AS hit FROM cand),
    upto AS (SELECT *, sum(hit) OVER (PARTITION BY phase ORDER BY h, image_id) AS hits FROM tried),
    kept AS (SELECT *, row_number() OVER (ORDER BY phase, h, image_id) - 1 AS pos FROM upto WHERE hits - hit < CASE phase WHEN 0 THEN {n0} ELSE {n - n0} END),
    streaks AS (SELECT *, pos - coalesce(max(CASE WHEN hit = 1 THEN pos END) OVER (ORDER BY pos), -1) AS streak FROM kept)
    SELECT image_id, phase, hit, pos, streak FROM streaks {stop}"""


def _acceptance(name: str, share: str, max_misses: int | None) -> None:
    n, frac = 2000, 0.3

    @register(name, oracle(_acceptance_sql(n, frac, share, max_misses)))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        candidates, targets = S.acceptance_candidates(table(spark, sf, "slice_index"), n, frac, LABELS)
        available = spark_sql(
            spark, sf, f"SELECT image_id FROM {{slices}} WHERE substr(md5(concat('available|', image_id)), 1, 1) < '{share}'"
        )
        out = S.ordered_acceptance(candidates, available, targets, max_misses=max_misses)
        return out.select("image_id", "phase", "hit", "pos", "streak")


_acceptance("ordered_acceptance", "e", None)
_acceptance("miss_streak_cutoff", "2", 40)


@register("random_positive_rows", oracle(f"SELECT image_id FROM ({{slice_index}}) WHERE any_hemorrhage = 1 ORDER BY md5(concat_ws('|', '0', image_id)), image_id LIMIT 300"))
def random_positive_rows(spark: SparkSession, sf: str) -> DataFrame:
    pop = table(spark, sf, "slice_index").filter(F.col("any_hemorrhage") == 1)
    return S.random_rows(pop, 300, ["image_id"]).select("image_id")


@register("first_case_per_label", oracle("SELECT any_hemorrhage, image_file FROM {manifest} QUALIFY row_number() OVER (PARTITION BY any_hemorrhage ORDER BY doc_id) = 1"))
def first_case_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_per_group(table(spark, sf, "manifest"), "any_hemorrhage", ["doc_id"]).select("any_hemorrhage", "image_file")


@register("first_n_per_folder", oracle("SELECT study_id, image_file, row_number() OVER (PARTITION BY study_id ORDER BY image_file) AS rank FROM {manifest} QUALIFY rank <= 2"))
def first_n_per_folder(spark: SparkSession, sf: str) -> DataFrame:
    return S.first_per_group(table(spark, sf, "manifest"), "study_id", ["image_file"], 2).select("study_id", "image_file", "rank")


@register("trial_limit", oracle("SELECT image_file FROM {manifest} ORDER BY image_file LIMIT 10"))
def trial_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The runner's first-N option."""
    return S.first_rows(table(spark, sf, "manifest").select("image_file"), 10, ["image_file"])
