"""Nearest neighbours, contrastive selection, hit rates, nulls, context and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit import fixed_values as V
from assaykit.functions.labels import answer_text
from assaykit.operators import context as C
from assaykit.operators import resample as R
from assaykit.operators import retrieval as X
from assaykit.operators.images import batch_encoder, embed
from assaykit.operators.nearest import nearest
from assaykit.operators.sampling import random_per_query
from assaykit.operators.text import encode
from assaykit.plans.evaluation import retrieval_decision, retrieval_verdict
from assaykit.plans.retrieval import exemplar_grid
from assaykit.plans.runs import RunSpec
from suite import register
from suite.derived import spark_sql, table

K = 5


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with its binary flag and its label set."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        "embedding",
        "label",
        (F.col("label") % 2).alias("flag"),
        F.array(F.col("label"), (F.floor(F.col("label") / 2) + 10).cast("int")).alias("labels"),
    )


def queries_of(v: DataFrame) -> DataFrame:
    return v.withColumnRenamed("vec_id", "query_id")


def pool_of(v: DataFrame) -> DataFrame:
    return v.withColumnRenamed("vec_id", "pool_id")


# Every pair of different vectors with its similarity; labels 10.. stand for pairs of classes.
SIMS = """
sims AS MATERIALIZED (
  SELECT q.vec_id AS query_id, p.vec_id AS pool_id, q.label AS ql, p.label AS pl, p.label % 2 AS flag,
         round(list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) AS sim
  FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id)"""
TOP = SIMS + f""",
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pool_id) AS rank FROM sims) WHERE rank <= {K})"""
# the two label sets {{l, 10 + l div 2}} overlap iff the pair classes are equal
SHARES = "ql // 2 = pl // 2"


@register("topk_cosine", f"WITH {TOP} SELECT query_id, pool_id, sim, rank FROM top")
def topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Exact top-5 of every vector among all others."""
    v = vectors(spark, sf)
    return nearest(queries_of(v), pool_of(v), K, exclude_self=True)


@register("topk_cosine_grid", f"WITH {TOP} SELECT query_id, pool_id, sim, rank FROM top")
def topk_cosine_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The same in rounds, the plan for two sides that are both too large to broadcast."""
    v = vectors(spark, sf)
    found = nearest(queries_of(v), pool_of(v), K, exclude_self=True, strategy="rounds", block_rows=200, chunk_bytes=200_000)
    return found


def contrastive_sql(n_pos: int, n_neg: int, position: str) -> str:
    slot = "n_pos_found + r"
    order = f"CASE WHEN role = 'positive' THEN r ELSE {slot} END"
    if (n_pos, n_neg) == (2, 1) and position == "first":
        order = "CASE WHEN role = 'positive' THEN r + 1 ELSE 1 END"
    if (n_pos, n_neg) == (2, 1) and position == "middle":
        order = "CASE WHEN role = 'positive' THEN 2 * r - 1 ELSE 2 END"
    return f"""WITH {SIMS},
    ref AS (SELECT query_id, first(flag ORDER BY sim DESC, pool_id) AS ref FROM sims GROUP BY query_id),
    ranked AS (SELECT s.*, CASE WHEN s.flag = r.ref THEN 'positive' ELSE 'negative' END AS role,
                      row_number() OVER (PARTITION BY s.query_id, s.flag = r.ref ORDER BY s.sim DESC, s.pool_id) AS r
               FROM sims s JOIN ref r ON s.query_id = r.query_id),
    kept AS (SELECT *, count(*) FILTER (role = 'positive') OVER (PARTITION BY query_id) AS n_pos_found FROM ranked
             WHERE (role = 'positive' AND r <= {n_pos}) OR (role = 'negative' AND r <= {n_neg}))
    SELECT query_id, {order} AS slot, role, pool_id, sim, flag FROM kept"""


def _contrastive(name: str, n_pos: int, n_neg: int, position: str) -> None:
    @register(name, contrastive_sql(n_pos, n_neg, position))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = vectors(spark, sf)
        chosen = X.contrastive(
            queries_of(v), pool_of(v), "flag", n_pos, n_neg, position, exclude_self=True
        )
        return chosen


_contrastive("contrastive_default", 2, 1, "last")
_contrastive("contrastive_negative_first", 2, 1, "first")
_contrastive("contrastive_negative_middle", 2, 1, "middle")
_contrastive("contrastive_three_positives", 3, 0, "last")
_contrastive("contrastive_two_negatives", 2, 2, "last")


@register(
    "contrastive_shortage",
    f"""WITH {SIMS},
    s AS (SELECT query_id, pool_id, sim, CASE WHEN pl = 9 AND substr(md5(cast(pool_id AS string)), 1, 1) < '3' THEN 1 ELSE 0 END AS rare FROM sims),
    ref AS (SELECT query_id, first(rare ORDER BY sim DESC, pool_id) AS ref FROM s GROUP BY query_id),
    ranked AS (SELECT s.*, s.rare = r.ref AS same, row_number() OVER (PARTITION BY s.query_id, s.rare = r.ref ORDER BY sim DESC, pool_id) AS side
               FROM s JOIN ref r ON s.query_id = r.query_id),
    picked AS (SELECT *, CASE WHEN same AND side <= 20 THEN 0 WHEN NOT same AND side <= 12 THEN 2 END AS pick FROM ranked),
    spare AS (SELECT *, CASE WHEN pick IS NULL THEN row_number() OVER (PARTITION BY query_id, pick IS NULL ORDER BY sim DESC, pool_id) END AS sp,
                     20 - count(*) FILTER (pick = 0) OVER (PARTITION BY query_id) AS short_pos,
                     12 - count(*) FILTER (pick = 2) OVER (PARTITION BY query_id) AS short_neg FROM picked),
    filled AS (SELECT *, coalesce(pick, CASE WHEN sp <= short_pos THEN 1 WHEN sp <= short_pos + short_neg THEN 3 END) AS kind FROM spare)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY kind, sim DESC, pool_id) AS slot,
           CASE WHEN kind <= 1 THEN 'positive' ELSE 'negative' END AS role, pool_id, sim, rare
    FROM filled WHERE kind IS NOT NULL""",
)
def contrastive_shortage(spark: SparkSession, sf: str) -> DataFrame:
    """More exemplars asked for than a rare label has: positives are filled before negatives."""
    v = vectors(spark, sf)
    few = F.substring(F.md5(F.col("pool_id").cast("string")), 1, 1) < "3"
    pool = pool_of(v).withColumn("rare", ((F.col("label") == 9) & few).cast("int"))
    chosen = X.contrastive(queries_of(v), pool, "rare", 20, 12, exclude_self=True)
    return chosen


def draws_sql(n: str, k: int, seed: str, key: str) -> str:
    """k distinct positions in [0, n), the i-th drawn among those left."""
    rank = f"(('0x' || substr(md5(concat_ws('|', '{seed}', {key}, i)), 1, 15))::bigint % ({n} - i))"
    step = f"lambda acc, i: list_append(acc, list_reduce(list_sort(acc), lambda v, p: v + (v >= p)::bigint, {rank}))"
    return f"list_reduce(range(least({k}, {n})), {step}, []::bigint[])"


def dense_sql(source: str, key: str, seed: str, within: str = "") -> str:
    part = f"PARTITION BY {within} " if within else ""
    return (
        f"SELECT *, row_number() OVER ({part}ORDER BY md5(concat_ws('|', '{seed}', {key})), {key}) - 1 AS idx FROM {source}"
    )


@register(
    "random_exemplars",
    f"""WITH pool AS ({dense_sql('embeddings', 'vec_id', '42')}),
    picks AS (SELECT vec_id AS query_id, {draws_sql('n', 3, '42', 'vec_id')} AS spots FROM embeddings, (SELECT count(*) AS n FROM embeddings)),
    flat AS (SELECT query_id, unnest(spots) AS idx, generate_subscripts(spots, 1) AS rank FROM picks)
    SELECT f.query_id, f.rank, p.vec_id AS pool_id FROM flat f JOIN pool p ON f.idx = p.idx""",
)
def random_exemplars(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return random_per_query(queries_of(v), pool_of(v), V.IMAGE_K)


@register(
    "contrastive_random_negative",
    f"""WITH {SIMS},
    ref AS (SELECT query_id, first(flag ORDER BY sim DESC, pool_id) AS ref FROM sims GROUP BY query_id),
    pos AS (SELECT s.query_id, s.pool_id, s.sim, s.flag, row_number() OVER (PARTITION BY s.query_id ORDER BY s.sim DESC, s.pool_id) AS slot
            FROM sims s JOIN ref r ON s.query_id = r.query_id AND s.flag = r.ref QUALIFY slot <= 2),
    pool AS ({dense_sql('(SELECT vec_id, label % 2 AS flag FROM embeddings)', 'vec_id', '42', 'flag')}),
    sizes AS (SELECT flag, count(*) AS n FROM pool GROUP BY flag),
    picks AS (SELECT r.query_id, s.flag, {draws_sql('n', 3, '42', 'query_id')}[1] AS idx FROM ref r JOIN sizes s ON s.flag <> r.ref)
    SELECT query_id, slot, 'positive' AS role, pool_id, sim, flag FROM pos
    UNION ALL
    SELECT k.query_id, 3, 'negative', p.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9), k.flag
    FROM picks k JOIN pool p ON p.flag = k.flag AND p.idx = k.idx JOIN embeddings q ON q.vec_id = k.query_id JOIN embeddings e ON e.vec_id = p.vec_id""",
)
def contrastive_random_negative(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    chosen = X.contrastive(queries_of(v), pool_of(v), "flag", random_neg=True, exclude_self=True)
    return chosen


@register(
    "negative_hardness",
    f"""WITH c AS ({contrastive_sql(2, 1, 'last')}),
    per AS (SELECT query_id, max(sim) FILTER (slot = 1) - max(sim) FILTER (role = 'negative') AS gap FROM c GROUP BY query_id)
    SELECT (SELECT count(*) FROM per) AS n, round((SELECT avg(sim) FROM c WHERE role = 'positive'), 6) AS positive_mean,
           round((SELECT avg(sim) FROM c WHERE role = 'negative'), 6) AS negative_mean, round(avg(gap), 6) AS gap_mean,
           round(stddev_pop(gap), 6) AS gap_std, round(min(gap), 6) AS gap_min, round(max(gap), 6) AS gap_max FROM per""",
)
def negative_hardness(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    out = X.hardness(X.contrastive(queries_of(v), pool_of(v), "flag", exclude_self=True))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@register(
    "hit_rate",
    f"WITH {TOP} SELECT count(*) FILTER ({SHARES}) AS n_matched, (SELECT count(*) FROM embeddings) AS n_query, "
    f"round(count(*) FILTER ({SHARES}) / ((SELECT count(*) FROM embeddings) * {K}.0), 6) AS hit_rate FROM top",
)
def hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    found = nearest(queries_of(v), pool_of(v), K, exclude_self=True)
    return X.hit_rate(found, queries_of(v), pool_of(v), K).withColumn("hit_rate", F.round("hit_rate", 6))


_KS = (1, 2, 4, 5)


@register(
    "hit_rate_k_sweep",
    f"WITH {TOP} "
    + " UNION ALL ".join(
        f"SELECT {k} AS k, round(count(*) FILTER ({SHARES}) / ((SELECT count(*) FROM embeddings) * {k}.0), 6) AS hit_rate FROM top WHERE rank <= {k}"
        for k in _KS
    ),
)
def hit_rate_k_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rate at several k from one retrieval."""
    v = vectors(spark, sf)
    found = nearest(queries_of(v), pool_of(v), max(_KS), exclude_self=True)
    return X.hit_rate_sweep(found, queries_of(v), pool_of(v), _KS).select("k", F.round("hit_rate", 6).alias("hit_rate"))


_SPECS = [
    RunSpec("plain", context="image", k=K),
    RunSpec("last", context="image", contrastive=True),
    RunSpec("first", context="image", contrastive=True, neg_position="first"),
    RunSpec("two", context="image", contrastive=True, n_pos=2, n_neg=2),
]


@register(
    "exemplar_grid",
    f"WITH {TOP} SELECT 'plain' AS run, query_id, rank AS slot, pool_id FROM top"
    + "".join(
        f" UNION ALL SELECT '{r.run}', query_id, slot, pool_id FROM ({contrastive_sql(r.n_pos, r.n_neg, r.neg_position)})"
        for r in _SPECS
        if r.contrastive
    ),
)
def exemplars(spark: SparkSession, sf: str) -> DataFrame:
    """Four retrieval settings from one pass over the pool."""
    v = vectors(spark, sf)
    out = exemplar_grid(queries_of(v), pool_of(v), _SPECS, "flag", exclude_self=True)
    return out.select("run", "query_id", "slot", "pool_id")


@register(
    "label_match_counts",
    "WITH m AS (SELECT q.vec_id, count(*) AS m FROM embeddings q JOIN embeddings p ON q.label // 2 = p.label // 2 GROUP BY q.vec_id) "
    "SELECT m, count(*) AS n_query FROM m GROUP BY m",
)
def label_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return R.match_counts(queries_of(v), pool_of(v))


_TRIALS = 20


@register(
    "permutation_null_keyed",
    f"""WITH pool AS ({dense_sql('embeddings', 'vec_id', '42')}),
    trials AS (SELECT t.t AS trial, e.vec_id, e.label AS ql, concat_ws('|', t.t, e.vec_id) AS k FROM embeddings e, range({_TRIALS}) t(t)),
    picks AS (SELECT trial, ql, unnest({draws_sql('n', K, '42', 'k')}) AS idx FROM trials, (SELECT count(*) AS n FROM embeddings))
    SELECT f.trial, round(count(*) FILTER (f.ql // 2 = p.label // 2) / ((SELECT count(*) FROM embeddings) * {K}.0), 6) AS hit_rate
    FROM picks f JOIN pool p ON f.idx = p.idx GROUP BY f.trial""",
)
def permutation_null_keyed(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    null = R.keyed_permutation_null(queries_of(v), pool_of(v), K, _TRIALS)
    return null.withColumn("hit_rate", F.round("hit_rate", 6))


def chance_sql(group: str, k: int = V.HIT_RATE_K) -> str:
    """Mean and standard deviation of the null's hit rate: each vector draws k of all, hypergeometrically."""
    return f"""sizes AS (SELECT count(*)::DOUBLE AS c, (SELECT count(*) FROM embeddings)::DOUBLE AS n FROM embeddings GROUP BY {group}),
    chance AS (SELECT sum(c * c) / any_value(n * n) AS mean,
      sqrt(sum(c * {k} * (c / n) * (1 - c / n) * (n - {k}) / (n - 1))) / any_value(n * {k}) AS sd FROM sizes)"""


def real_sql(group: str, k: int = V.HIT_RATE_K) -> str:
    """Hit rate of the nearest k among all vectors, the query's own included."""
    return f"""real AS (SELECT count(*) FILTER (q_group = p_group) / ((SELECT count(*) FROM embeddings) * {k}.0) AS hit_rate FROM (
      SELECT q.g AS q_group, p.g AS p_group, row_number() OVER (
        PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 9) DESC, p.vec_id) AS rank
      FROM (SELECT *, {group} AS g FROM embeddings) q CROSS JOIN (SELECT *, {group} AS g FROM embeddings) p QUALIFY rank <= {k}))"""


def expected_rate(v: DataFrame) -> DataFrame:
    """One row: the null's exact mean, the share of pool rows that a query shares a label with."""
    n = v.agg(F.count(F.lit(1)).alias("n")).scalar()
    met = R.match_counts(queries_of(v), pool_of(v))
    return met.agg((F.sum(F.col("m") * F.col("n_query")) / F.sum("n_query")).alias("s")).select((F.col("s") / n).alias("expected"))


@register(
    "permutation_null",
    f"WITH {chance_sql('label // 2')} SELECT {V.N_TRIALS} AS n_trials, round(mean, 6) AS expected, true AS near FROM chance",
)
def permutation_null(spark: SparkSession, sf: str) -> DataFrame:
    """The default null, 1000 trials: its exact mean, and whether the trials' mean lies within four standard errors."""
    v = vectors(spark, sf)
    trials = R.permutation_null(queries_of(v), pool_of(v)).agg(
        F.count(F.lit(1)).alias("n_trials"), F.avg("hit_rate").alias("mean"), F.stddev("hit_rate").alias("sd")
    )
    near = F.abs(F.col("mean") - F.col("expected")) <= 4 * F.col("sd") / F.sqrt("n_trials")
    # one row meets one row
    return trials.crossJoin(expected_rate(v)).select("n_trials", F.round("expected", 6).alias("expected"), near.alias("near"))


@register(
    "retrieval_verdict",
    f"""WITH {chance_sql('label // 2')}, {real_sql('label // 2')}
    SELECT round(hit_rate, 6) AS real_hit_rate, round(mean, 6) AS expected, true AS ordered, hit_rate >= mean + 1.645 * sd AS passed FROM real, chance""",
)
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Real hit rate, the null's exact mean, the verdict, and whether the null's threshold lies above its mean."""
    v = vectors(spark, sf)
    out = retrieval_verdict(queries_of(v), pool_of(v)).crossJoin(expected_rate(v))
    return out.select(
        F.round("real_hit_rate", 6).alias("real_hit_rate"),
        F.round("expected", 6).alias("expected"),
        (F.col("null_threshold") >= F.col("null_mean")).alias("ordered"),
        "passed",
    )


_NOISE = "substr(md5(vec_id::VARCHAR), 1, 1)"


@register(
    "retrieval_decision",
    f"""WITH {chance_sql(_NOISE)}, {real_sql(_NOISE)}
    SELECT CASE WHEN hit_rate >= mean + 1.645 * sd THEN 'B' ELSE 'not by the first verdict' END AS decision, false AS histogram_matched,
      {V.HIT_RATE_K} AS k, (SELECT count(*) FROM embeddings) AS n_query, (SELECT count(*) FROM embeddings) AS n_pool,
      round(hit_rate, 6) AS real_hit_rate FROM real, chance""",
)
def decision(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on the raw pool, if need be again after one histogram match."""
    from suite.images import PIXELS

    v = vectors(spark, sf).withColumn("pixels", F.expr(PIXELS))
    # labels unrelated to the vectors; what passes is that every vector finds itself
    noise = F.array(F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 1), 16, 10).cast("int"))
    v = v.withColumn("labels", noise)

    def embed_matched(pool: DataFrame) -> DataFrame:
        return embed(pool, lambda c: F.transform(c, lambda x: (x - 127.5).cast("float")))

    reference = v.filter(F.col("vec_id") == v.agg(F.min("vec_id")).scalar())
    out = retrieval_decision(queries_of(v), pool_of(v), embed_matched, reference, n_trials=200)
    row = [out[c] for c in ("decision", "histogram_matched", "k", "n_query", "n_pool")] + [round(out["real_hit_rate"], 6)]
    return spark.createDataFrame([row], "decision string, histogram_matched boolean, k int, n_query long, n_pool long, real_hit_rate double")


@register(
    "rendition_overlap",
    f"""WITH {TOP}, low AS (SELECT q.vec_id AS query_id, p.vec_id AS pool_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY
      round(list_dot_product(q.e, p.e), 9) DESC, p.vec_id) AS rank
      FROM (SELECT vec_id, list_transform(embedding, lambda x: (round(x::DOUBLE * 8) / 8)::FLOAT)::DOUBLE[] AS e FROM embeddings) q
      JOIN (SELECT vec_id, list_transform(embedding, lambda x: (round(x::DOUBLE * 8) / 8)::FLOAT)::DOUBLE[] AS e FROM embeddings) p ON q.vec_id <> p.vec_id
      QUALIFY rank <= {K}),
    shared AS (SELECT t.query_id, count(*) AS n FROM top t JOIN low l ON t.query_id = l.query_id AND t.pool_id = l.pool_id GROUP BY t.query_id)
    SELECT q.vec_id AS query_id, coalesce(s.n, 0) AS n_shared, round(coalesce(s.n, 0) / {K}.0, 6) AS overlap
    FROM embeddings q LEFT JOIN shared s ON q.vec_id = s.query_id""",
)
def rendition_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Top-5 lists of the full and of a coarser rendition of every vector."""
    v = vectors(spark, sf)
    coarse = v.withColumn("embedding", F.transform("embedding", lambda x: (F.round(x.cast("double") * 8) / 8).cast("float")))
    a = nearest(queries_of(v), pool_of(v), K, exclude_self=True)
    b = nearest(queries_of(coarse), pool_of(coarse), K, exclude_self=True)
    return X.list_overlap(a, b, K).withColumn("overlap", F.round("overlap", 6))


@register(
    "hit_rate_by_rendition",
    " UNION ALL ".join(
        f"""SELECT {g} AS grid, round(count(*) FILTER (ql // 2 = pl // 2) / ((SELECT count(*) FROM embeddings) * {K}.0), 6) AS hit_rate FROM (
        SELECT q.label AS ql, p.label AS pl, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, p.e), 9) DESC, p.vec_id) AS rank
        FROM (SELECT vec_id, label, list_transform(embedding, lambda x: (round(x::DOUBLE * {g}) / {g})::FLOAT)::DOUBLE[] AS e FROM embeddings) q
        JOIN (SELECT vec_id, label, list_transform(embedding, lambda x: (round(x::DOUBLE * {g}) / {g})::FLOAT)::DOUBLE[] AS e FROM embeddings) p
        ON q.vec_id <> p.vec_id QUALIFY rank <= {K})"""
        for g in (8, 32)
    ),
)
def hit_rate_by_rendition(spark: SparkSession, sf: str) -> DataFrame:
    """Same-label hit rate per index version, a resolution sweep."""
    v = vectors(spark, sf)
    rows = None
    for g in (8, 32):
        r = v.withColumn("embedding", F.transform("embedding", lambda x: (F.round(x.cast("double") * g) / g).cast("float")))
        found = nearest(queries_of(r), pool_of(r), K, exclude_self=True)
        one = X.hit_rate(found, queries_of(r), pool_of(r), K).select(F.lit(g).alias("grid"), F.round("hit_rate", 6).alias("hit_rate"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@register(
    "index_check",
    f"""WITH {SIMS},
    q AS (SELECT vec_id FROM embeddings WHERE label % 2 = 1 ORDER BY md5(concat_ws('|', '0', vec_id)), vec_id LIMIT 3),
    n AS (SELECT s.*, row_number() OVER (PARTITION BY s.query_id ORDER BY sim DESC, pool_id) AS rank FROM sims s JOIN q ON s.query_id = q.vec_id)
    SELECT query_id, rank, pool_id, sim, CASE WHEN ql % 2 = 1 THEN concat('L', ql) ELSE 'none' END AS query_labels,
           CASE WHEN pl % 2 = 1 THEN concat('L', pl) ELSE 'none' END AS pool_labels FROM n WHERE rank <= 3""",
)
def index_check(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of three random positives inside their own index."""
    v = vectors(spark, sf)
    text = F.when(F.col("flag") == 1, F.concat(F.lit("L"), F.col("label").cast("string"))).otherwise(F.lit(""))
    index = v.withColumn("names", text)
    out = X.index_check(index, key="vec_id", labels="names", positive="flag")
    return out


# -- text ---------------------------------------------------------------------

_DIM = 64


def encoded_sql(source: str, key: str) -> str:
    """Hashed term counts of unit length, as float vectors."""
    terms = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
    slots = f"list_transform({terms}, lambda t: ('0x' || substr(md5(t), 1, 3))::bigint % {_DIM})"
    return (
        f"SELECT {key}, list_transform(n, lambda x: coalesce(x / nullif(sqrt(list_sum(list_transform(n, lambda y: y * y))), 0), 0)::FLOAT)::DOUBLE[] AS e FROM ("
        f"SELECT {key}, list_transform(range({_DIM}), lambda d: len(list_filter(s, lambda x: x = d))::DOUBLE) AS n FROM ("
        f"SELECT {key}, {slots} AS s FROM {source}))"
    )


def text_top_sql(source: str, key: str, k: int) -> str:
    return f"""q AS MATERIALIZED ({encoded_sql(source, key)}), d AS MATERIALIZED ({encoded_sql('benchmark', 'item_id')}),
    hits AS (SELECT q.{key} AS query_id, d.item_id AS doc_id, round(list_dot_product(q.e, d.e), 9) AS sim,
             row_number() OVER (PARTITION BY q.{key} ORDER BY round(list_dot_product(q.e, d.e), 9) DESC, d.item_id) AS rank
             FROM q JOIN d ON true QUALIFY rank <= {k})"""


def _kb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")


@register(
    "text_topk",
    f"WITH {text_top_sql('documents', 'doc_id', V.TEXT_K)} SELECT query_id, doc_id, sim, rank FROM hits",
)
def text_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts against the knowledge base."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    hits = C.text_top_k(docs, _kb(spark, sf))
    return hits.select("query_id", "doc_id", "sim", "rank")


@register(
    "text_context",
    f"WITH {text_top_sql('documents', 'doc_id', 2)} SELECT h.query_id, md5(concat('" + V.TEXT_CONTEXT_HEADER + "', chr(10), "
    "string_agg(concat('- ', b.text), chr(10) ORDER BY h.rank))) AS context_md5 FROM hits h JOIN benchmark b ON b.item_id = h.doc_id GROUP BY h.query_id",
)
def text_context(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), "text")
    ctx = C.build_context(docs, "text", C.text_top_k(docs, _kb(spark, sf), 2))
    return ctx.select("query_id", F.md5("context").alias("context_md5"))


@register(
    "two_stage_context",
    f"WITH f AS (SELECT conv_id * 1000 + turn AS turn_id, text FROM conversations), {text_top_sql('f', 'turn_id', V.TWO_STAGE_K)} "
    "SELECT h.query_id, md5(concat('BASE', chr(10), chr(10), '" + V.TEXT_CONTEXT_HEADER + "', chr(10), "
    "string_agg(concat('- ', b.text), chr(10) ORDER BY h.rank))) AS prompt_md5 FROM hits h JOIN benchmark b ON b.item_id = h.doc_id GROUP BY h.query_id",
)
def two_stage_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn as first-pass findings that query the knowledge base for the second prompt."""
    findings = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("stage1_findings")
    )
    out = C.two_stage_context(findings, _kb(spark, sf))
    return out.select("query_id", F.md5(C.system_prompt("BASE", F.col("context"))).alias("prompt_md5"))


LABEL_TEXT = (
    "CASE WHEN IPH + IVH + SAH + EDH + SDH = 0 THEN concat('HEMORRHAGE: no', chr(10), 'SUBTYPES: none') ELSE "
    "concat('HEMORRHAGE: yes', chr(10), 'SUBTYPES: ', concat_ws(', ', CASE WHEN IPH = 1 THEN 'IPH' END, CASE WHEN IVH = 1 THEN 'IVH' END, "
    "CASE WHEN SAH = 1 THEN 'SAH' END, CASE WHEN EDH = 1 THEN 'EDH' END, CASE WHEN SDH = 1 THEN 'SDH' END)) END"
)
# vectors with five flags by label digit
FLAGGED = (
    "SELECT vec_id, embedding, CASE WHEN label IN (1, 6) THEN 1 ELSE 0 END AS IPH, CASE WHEN label IN (2, 6) THEN 1 ELSE 0 END AS IVH, "
    "CASE WHEN label IN (3, 7) THEN 1 ELSE 0 END AS SAH, CASE WHEN label IN (4, 7) THEN 1 ELSE 0 END AS EDH, "
    "CASE WHEN label = 5 THEN 1 ELSE 0 END AS SDH FROM {embeddings}"
)


@register(
    "few_shot_messages",
    f"""WITH {TOP}, f AS (SELECT vec_id, {LABEL_TEXT} AS answer FROM ({FLAGGED.replace('{embeddings}', 'embeddings')})),
    shots AS (SELECT t.query_id, string_agg(concat('user:image=', t.pool_id, ';text=Q;assistant:text=', f.answer, ';'), '' ORDER BY t.rank) AS body
              FROM top t JOIN f ON f.vec_id = t.pool_id WHERE t.rank <= {V.IMAGE_K} GROUP BY t.query_id)
    SELECT query_id, md5(concat('system:text=SYS;', body, 'user:image=', query_id, ';text=Q;')) AS chat_md5, {V.IMAGE_K} * 2 + 2 AS n_messages FROM shots""",
)
def few_shot_messages(spark: SparkSession, sf: str) -> DataFrame:
    """System, one question / answer pair per exemplar, then the query image."""
    flagged = spark_sql(spark, sf, FLAGGED).withColumn("label_text", answer_text())
    v = flagged.select(F.col("vec_id").alias("query_id"), "embedding")
    pool = flagged.withColumnRenamed("vec_id", "pool_id")
    chosen = nearest(v, pool, V.IMAGE_K, exclude_self=True).withColumnRenamed("rank", "slot")
    ctx = C.build_context(v.select("query_id"), "image", chosen, pool)
    chat = C.few_shot_messages(F.col("query_id").cast("string"), F.col("exemplars"), "Q", "SYS")

    def show(m):
        parts = F.transform(
            m["content"], lambda p: F.concat(p["type"], F.lit("="), F.coalesce(p["text"], p["image"]), F.lit(";"))
        )
        return F.concat(m["role"], F.lit(":"), F.array_join(parts, ""))

    flat = F.array_join(F.transform("chat", show), "")
    return ctx.withColumn("chat", chat).select("query_id", F.md5(flat).alias("chat_md5"), F.size("chat").alias("n_messages"))


@register(
    "batch_embedding",
    "SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 4) AS squared_norm, round(e[1], 3) AS first, round(e[4], 3) AS last FROM ("
    "SELECT vec_id, list_transform(s, lambda x: x / sqrt(list_sum(list_transform(s, lambda y: y * y)))) AS e FROM ("
    "SELECT vec_id, [list_sum(embedding[1:16]::DOUBLE[]), list_sum(embedding[17:32]::DOUBLE[]), list_sum(embedding[33:48]::DOUBLE[]), "
    "list_sum(embedding[49:64]::DOUBLE[])] AS s FROM embeddings))",
)
def batch_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """A user-supplied encoder (sums over four stretches), run in batches and normalised."""

    def make_encoder():
        def predict(x):
            return x.astype("float64").reshape(len(x), 4, 16).sum(axis=2).astype("float32")

        return predict

    out = embed(table(spark, sf, "embeddings").drop("label").withColumnRenamed("embedding", "content"), batch_encoder(make_encoder, 256, [64]), "content")
    e = F.col("embedding")
    squares = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return out.select(
        "vec_id", F.round(squares, 4).alias("squared_norm"), F.round(e[0].cast("double"), 3).alias("first"), F.round(e[3].cast("double"), 3).alias("last")
    )


@register(
    "text_vectors",
    f"SELECT doc_id, round(list_sum(list_transform(e, lambda x: x * x)), 4) AS squared_norm, round(e[1], 5) AS first, round(e[64], 5) AS last FROM ({encoded_sql('documents', 'doc_id')})",
)
def text_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    squares = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return encode(table(spark, sf, "documents")).select(
        "doc_id", F.round(squares, 4).alias("squared_norm"), F.round(e[0].cast("double"), 5).alias("first"), F.round(e[63].cast("double"), 5).alias("last")
    )
