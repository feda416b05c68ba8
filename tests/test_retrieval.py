import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import retrieval as X
from assaykit.operators import topk
from assaykit.operators.nearest import nearest
from assaykit.operators.sampling import random_per_query


def unit(rng, n, d=16):
    v = rng.normal(size=(n, d)).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frames(spark, q, p, qid=int, pid=int, cls=None):
    kinds = {int: "long", str: "string"}
    qs = spark.createDataFrame([(qid(i), v.tolist()) for i, v in enumerate(q)], f"query_id {kinds[qid]}, embedding array<float>")
    ps = spark.createDataFrame(
        [(pid(i), v.tolist(), int(cls[i]) if cls is not None else 0) for i, v in enumerate(p)], f"pool_id {kinds[pid]}, embedding array<float>, flag int"
    )
    return qs, ps.repartition(3)


def brute(q, p, k, order_key=int, skip_self=False, allowed=None):
    sims = np.round(q.astype(np.float64) @ p.astype(np.float64).T, 9)
    out = {}
    for i, row in enumerate(sims):
        ids = [j for j in range(len(p)) if not (skip_self and i == j) and (allowed is None or allowed[j])]
        out[i] = sorted(ids, key=lambda j: (-row[j], order_key(j)))[:k]
    return out


def lists(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(int(r.query_id), []).append(int(r.pool_id))
    return got


STRATEGIES = ["stream_pool", "stream_queries", "rounds"]


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("ids", [int, str])
def test_exact_with_heavy_ties(spark, strategy, ids):
    rng = np.random.default_rng(1)
    q, p = unit(rng, 23), unit(rng, 120)
    p[::3] = p[0]  # a third of the pool is one vector
    qs, ps = frames(spark, q, p, ids, ids)
    got = nearest(qs, ps, 7, strategy=strategy, block_rows=10)
    assert lists(got) == brute(q, p, 7, order_key=ids)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_self_is_skipped_and_short_pools_are_returned_whole(spark, strategy):
    rng = np.random.default_rng(2)
    v = unit(rng, 6)
    qs, ps = frames(spark, v, v)
    got = nearest(qs, ps, 10, exclude_self=True, strategy=strategy, block_rows=2)
    assert lists(got) == brute(v, v, 10, skip_self=True)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_per_class(spark, strategy):
    rng = np.random.default_rng(3)
    q, p = unit(rng, 9), unit(rng, 50)
    cls = rng.integers(0, 2, 50)
    qs, ps = frames(spark, q, p, cls=cls)
    got = nearest(qs, ps, 4, by="flag", strategy=strategy, block_rows=8)
    for c in (0, 1):
        assert lists(got.filter(F.col("flag") == c)) == brute(q, p, 4, allowed=cls == c)


def test_default_strategy_respects_the_broadcast_limit(spark):
    rng = np.random.default_rng(4)
    q, p = unit(rng, 30), unit(rng, 40)
    qs, ps = frames(spark, q, p)
    seen = []
    got = nearest(qs, ps, 3, broadcast_bytes=100, block_rows=7, on_round=lambda *x: seen.append(x))
    assert len(seen) > 1 and lists(got) == lists(nearest(qs, ps, 3)) == brute(q, p, 3)
    # what is left to do at the end is to rank winners: no vector is read again, none was copied
    plan = got._jdf.queryExecution().toString()
    assert "Generate" not in plan and "embedding" not in plan


def clustered(rng, n, clusters, dim=16):
    centre = rng.normal(size=(clusters, dim))
    v = centre[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * 0.02
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("n_q,n_p", [(90, 400), (400, 90)])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_pruned_rounds_read_less_and_find_the_same(spark, n_q, n_p, exclude_self):
    rng = np.random.default_rng(8)
    both = clustered(rng, n_q + n_p, 8)
    q, p = both[:n_q], both[n_q:]
    qs, ps = frames(spark, q, p)
    read = {True: [], False: []}
    for prune in read:
        got = nearest(qs, ps, 4, exclude_self=exclude_self, strategy="rounds", block_rows=15, chunk_bytes=3000, prune=prune, on_round=lambda *x: read[prune].append(x[1:]))
        assert lists(got) == brute(q, p, 4, skip_self=exclude_self)
    assert sum(n for n, _ in read[True]) < sum(n for n, _ in read[False])


def test_rounds_on_vectors_of_any_length(spark):
    rng = np.random.default_rng(9)
    q, p = rng.normal(size=(40, 8)) * rng.uniform(0, 3, (40, 1)), rng.normal(size=(70, 8)) * rng.uniform(0, 3, (70, 1))
    p[5] = p[6] = 0
    q[3] = 0
    qs, ps = frames(spark, q.astype("float32").astype(float), p.astype("float32").astype(float))
    want = lists(nearest(qs, ps, 5, strategy="stream_pool"))
    assert lists(nearest(qs, ps, 5, strategy="rounds", block_rows=6, chunk_bytes=900)) == want


def test_few_rounds_however_small_the_chunks(spark):
    rng = np.random.default_rng(11)
    v = unit(rng, 600, 8)
    qs, ps = frames(spark, v, v)
    seen = []
    got = nearest(qs, ps, 3, exclude_self=True, strategy="rounds", block_rows=5, chunk_bytes=700, on_round=lambda *x: seen.append(x))
    assert lists(got) == brute(v, v, 3, skip_self=True)
    assert len(seen) <= 16


@pytest.mark.parametrize("scale", [1.0, 50.0])
def test_rows_ruled_out_in_single_precision_change_nothing(scale):
    rng = np.random.default_rng(12)
    p = unit(rng, 6000) * np.float32(scale)
    p[100:4000:13] = p[7]  # ties
    p[4001] = p[7] + np.float32(1e-7)  # nearer than single precision can tell
    q = np.vstack([p[:40], p[4001:4003]])
    for who in (None, np.arange(0, 42, 2)):
        running = topk.Running(np.arange(42), q, 5, True)
        running.add(np.arange(6000), p, None)
        sims, ids = running.best[None]
        products = np.rint(q.astype(np.float64) @ p.astype(np.float64).T * 1e9)
        for i in range(42):
            order = sorted((j for j in range(6000) if j != i), key=lambda j: (-products[i, j], j))[:5]
            assert ids[i].tolist() == order
        if who is not None:
            running.add(np.array([7000, 7001]), p[[7, 9]], None, who, sims[who, -1])
            assert all(running.best[None][0][i, -1] >= sims[i, -1] for i in range(42))


def test_known_rows_leave_few_products_in_double_precision(monkeypatch):
    whole = []
    monkeypatch.setattr(topk, "_whole_product", lambda q, p, *rest, do=topk._whole_product: (whole.append(len(p)), do(q, p, *rest)))
    v = unit(np.random.default_rng(13), 30_000)
    topk.Running(np.arange(50), v[:50], 5, True).add(np.arange(30_000), v, None)
    assert sum(whole) <= topk.FIRST_ROWS


def test_bad_input(spark):
    qs, ps = frames(spark, unit(np.random.default_rng(5), 2), unit(np.random.default_rng(5), 2, 8))
    with pytest.raises(ValueError, match="differ in length"):
        nearest(qs, ps, 1)
    with pytest.raises(ValueError):
        nearest(qs, ps, 0)


def test_no_rows(spark):
    qs, ps = frames(spark, unit(np.random.default_rng(6), 2), unit(np.random.default_rng(6), 3))
    assert nearest(qs.limit(0), ps, 2).count() == 0
    assert nearest(qs, ps.limit(0), 2).count() == 0


# -- contrastive --------------------------------------------------------------


def select(spark, sims, labels, n_pos=2, n_neg=1, position="last"):
    df = spark.createDataFrame([("q", i, s, lab) for i, (s, lab) in enumerate(zip(sims, labels))], "query_id string, pool_id int, sim double, any_hemorrhage int")
    return [r.pool_id for r in X.select_contrastive(df, "any_hemorrhage", n_pos, n_neg, position).orderBy("slot").collect()]


@pytest.mark.parametrize(
    "sims, labels, options, want",
    [
        ([0.9, 0.8, 0.7, 0.6, 0.5, 0.4], [1, 1, 0, 1, 0, 0], {}, [0, 1, 2]),
        ([0.9, 0.8, 0.7, 0.6, 0.5, 0.4], [0, 0, 1, 0, 1, 1], {}, [0, 1, 2]),
        ([0.95, 0.90, 0.85, 0.80, 0.75, 0.10], [1, 1, 1, 0, 0, 0], {}, [0, 1, 3]),
        ([0.9, 0.8, 0.7, 0.6, 0.5], [1, 1, 1, 1, 1], {}, [0, 1, 2]),
        ([0.9, 0.8, 0.7], [1, 1, 0], {}, [0, 1, 2]),
        ([0.9, 0.8, 0.7, 0.6, 0.5], [1, 1, 0, 0, 0], {"position": "first"}, [2, 0, 1]),
        ([0.9, 0.8, 0.7, 0.6, 0.5], [1, 1, 0, 0, 0], {"position": "middle"}, [0, 2, 1]),
        ([0.9, 0.8, 0.7, 0.6, 0.5], [1, 1, 0, 1, 0], {"n_pos": 3, "n_neg": 0}, [0, 1, 3]),
        ([0.9, 0.8, 0.7, 0.6, 0.5, 0.4], [1, 1, 0, 0, 1, 0], {"n_pos": 2, "n_neg": 2}, [0, 1, 2, 3]),
        ([0.9, 0.8, 0.7], [1, 0, 1], {"n_pos": 1, "n_neg": 1}, [0, 1]),
        ([0.9, 0.8, 0.7], [1, 1, 1], {"n_pos": 0, "n_neg": 1}, [1]),
        ([0.9, 0.8, 0.7], [1, 1, 0], {"n_pos": 0, "n_neg": 1}, [2]),
        ([0.9], [1], {"n_pos": 0, "n_neg": 1}, []),
        # one row of the nearest label: the second positive is the next nearest left after the negative
        ([0.9, 0.8, 0.7, 0.6], [1, 0, 0, 0], {}, [0, 2, 1]),
        ([0.9, 0.8], [1, 0], {}, [0, 1]),
        ([0.9], [1], {"position": "first"}, [0]),
    ],
)
def test_selection_cases(spark, sims, labels, options, want):
    assert select(spark, sims, labels, **options) == want


def by_rule(sims, labels, n_pos, n_neg):
    """The rule in plain words: positives, negatives, then fills."""
    order = sorted(range(len(sims)), key=lambda i: (-sims[i], i))
    ref = labels[order[0]]
    pos = [i for i in order if labels[i] == ref][:n_pos]
    neg = [i for i in order if labels[i] != ref][:n_neg]
    rest = [i for i in order if i not in pos and i not in neg]
    fill = n_pos - len(pos)
    pos, rest = pos + rest[:fill], rest[fill:]
    return pos + neg + rest[: n_neg - len(neg)]


def test_selection_equals_the_rule_on_random_pools(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for q in range(120):
        n = int(rng.integers(1, 9))
        sims, labels = rng.permutation(20)[:n] / 20, (rng.random(n) < rng.random()).astype(int)
        rows += [(q, i, float(s), int(c)) for i, (s, c) in enumerate(zip(sims, labels))]
        want[q] = by_rule(sims, labels, 3, 2)
    df = spark.createDataFrame(rows, "query_id int, pool_id int, sim double, any_hemorrhage int")
    got = {}
    for r in X.select_contrastive(df, n_pos=3, n_neg=2).orderBy("query_id", "slot").collect():
        got.setdefault(r.query_id, []).append(r.pool_id)
    assert got == want


def test_random_negatives(spark):
    rng = np.random.default_rng(8)
    q, p = unit(rng, 60), unit(rng, 30)
    cls = np.array([1] * 22 + [0] * 8)
    qs, ps = frames(spark, q, p, cls=cls)

    def run(seed, pool=ps):
        out = X.contrastive(qs, pool, "flag", random_neg=True, seed=seed)
        return {(r.query_id, r.slot): (r.role, r.pool_id, r.flag, r.sim) for r in out.collect()}

    a = run(1)
    assert a == run(1, ps.repartition(7)) and a != run(2)
    sims = q.astype(np.float64) @ p.astype(np.float64).T
    for i in range(60):
        ref = a[i, 1][2]
        assert [a[i, s][0] for s in (1, 2, 3)] == ["positive", "positive", "negative"]
        assert a[i, 2][2] == ref and a[i, 3][2] != ref
        assert abs(a[i, 3][3] - sims[i, a[i, 3][1]]) < 1e-6
    assert len({v[1] for (_, s), v in a.items() if s == 3}) > 5


def test_random_negatives_with_shortages(spark):
    rng = np.random.default_rng(9)
    q, p = unit(rng, 20), unit(rng, 5)
    qs, ps = frames(spark, q, p, cls=[1, 0, 0, 0, 0])
    out = X.contrastive(qs, ps, "flag", n_pos=2, n_neg=3, random_neg=True)
    for i in range(20):
        rows = out.filter(F.col("query_id") == i).collect() if i < 2 else None
        if rows:
            assert len({r.pool_id for r in rows}) == len(rows) == 5
    assert out.count() == 100


def test_random_exemplars_are_distinct_and_uniform(spark):
    qs = spark.range(3000).withColumnRenamed("id", "query_id")
    ps = spark.range(10).withColumnRenamed("id", "pool_id")
    out = random_per_query(qs, ps, 3)
    per = out.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("pool_id").alias("d")).agg(F.min("n"), F.max("n"), F.min("d")).first()
    assert tuple(per) == (3, 3, 3)
    for rank in (1, 2, 3):
        hits = [r["count"] for r in out.filter(F.col("rank") == rank).groupBy("pool_id").count().collect()]
        assert len(hits) == 10 and min(hits) > 230 and max(hits) < 370
    assert random_per_query(qs.limit(2), ps.limit(2), 3).count() == 4
    assert random_per_query(qs.limit(2), ps.limit(0), 3).count() == 0


def test_hit_rate_divides_by_k_as_asked(spark):
    q = spark.createDataFrame([(0, ["a"]), (1, ["b"])], "query_id long, labels array<string>")
    p = spark.createDataFrame([(0, ["a"]), (1, ["c"])], "pool_id long, labels array<string>")
    found = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "query_id long, pool_id long")
    assert X.hit_rate(found, q, p, 5).first().hit_rate == pytest.approx(0.1)
