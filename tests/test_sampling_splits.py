import hashlib
import itertools
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import suite
from assaykit.operators import membership
from assaykit.operators import sampling as S
from assaykit.operators import splits as P
from assaykit.operators.ordering import dense_index
from assaykit.operators.quantiles import exact_quantile
from assaykit.operators.sampling import multilabel_sample
from assaykit.operators.stratify import _total, long_list_sample
from assaykit.sources.labels import parse_listing

LABELS = ["IPH", "IVH"]


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def population(spark, rows):
    """rows: (normal, IPH, IVH, count); the first group may be most of the data."""
    data, i = [], itertools.count()
    for normal, a, b, n in rows:
        data += [(f"k{next(i)}", normal, a, b) for _ in range(n)]
    return spark.createDataFrame(data, "image_file string, is_normal boolean, IPH int, IVH int").repartition(4)


def shape(df):
    return {(r.is_normal, r.IPH, r.IVH): r["count"] for r in df.groupBy("is_normal", *LABELS).count().collect()}


def test_quotas_follow_the_population(spark):
    pop = population(spark, [(True, 0, 0, 3000), (False, 1, 0, 600), (False, 0, 1, 300), (False, 1, 1, 99), (False, 0, 0, 1)])
    got = shape(S.enriched_sample(pop, 100, 0.3, LABELS))
    assert got == {(True, 0, 0): 30, (False, 1, 0): 42, (False, 0, 1): 21, (False, 1, 1): 7}


@pytest.mark.parametrize(
    "n, frac, topup, normals, others",
    [(40, 0.3, True, 30, 10), (40, 0.3, False, 12, 10), (5, 0.5, True, 2, 3), (7, 0.5, True, 4, 3), (1000, 0.3, True, 50, 10), (1000, 0.9, False, 50, 10)],
)
def test_shortages_and_half_even_rounding(spark, n, frac, topup, normals, others):
    pop = population(spark, [(True, 0, 0, 50), (False, 1, 0, 6), (False, 0, 1, 4)])
    got = shape(S.enriched_sample(pop, n, frac, LABELS, topup=topup))
    assert got.get((True, 0, 0), 0) == normals and sum(v for k, v in got.items() if not k[0]) == others


def test_no_positives_at_all(spark):
    pop = population(spark, [(True, 0, 0, 50)])
    assert shape(S.enriched_sample(pop, 20, 0.3, LABELS, topup=False)) == {(True, 0, 0): 6}
    assert shape(S.enriched_sample(pop, 20, 0.3, LABELS)) == {(True, 0, 0): 20}


def test_sample_is_the_smallest_hashes_and_ignores_layout(spark):
    pop = population(spark, [(False, 1, 0, 9000), (False, 0, 1, 500)])
    a = {r.image_file for r in S.multilabel_sample(pop, 950, LABELS, ["image_file"]).collect()}
    b = {r.image_file for r in S.multilabel_sample(pop.repartition(1), 950, LABELS, ["image_file"]).collect()}
    hot = sorted((md5(42, f"k{i}"), f"k{i}") for i in range(9000))[:900]
    assert a == b and len(a) == 950 and {k for _, k in hot} <= a
    assert a != {r.image_file for r in S.multilabel_sample(pop, 950, LABELS, ["image_file"], seed=1).collect()}


def test_hot_stratum_is_split_over_tasks(spark):
    pop = population(spark, [(False, 1, 0, 20000), (False, 0, 1, 10)])
    out = dense_index(pop, 1, ["image_file"], ["IPH"]).filter("IPH = 1")
    assert out.agg(F.count_distinct("idx"), F.min("idx"), F.max("idx")).first()[0:] == (20000, 0, 19999)
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) < 15000 or len(per_task) > 1


def test_random_rows_of_an_empty_or_short_table(spark):
    df = spark.range(5)
    assert S.random_rows(df, 3, ["id"]).count() == 3
    assert S.random_rows(df, 30, ["id"]).count() == 5
    assert S.random_rows(df.limit(0), 3, ["id"]).count() == 0


def sequential(phases, available, targets, max_misses, seed=42):
    """Acceptance one candidate after the other."""
    out, pos, streak = [], 0, 0
    for phase, keys in enumerate(phases):
        hits = 0
        for k in sorted(keys, key=lambda k: (md5(f"{seed}-order", k), k)):
            if hits >= targets[phase]:
                break
            hit = int(k in available)
            streak = 0 if hit else streak + 1
            out.append((k, phase, hit, pos, streak))
            hits, pos = hits + hit, pos + 1
            if max_misses and streak >= max_misses:
                return out
    return out


@pytest.mark.parametrize(
    "share, targets, max_misses",
    [(0.9, [50, 80], None), (0.1, [50, 80], None), (0.12, [30, 40], 20), (0.02, [30, 40], 40), (0.0, [3, 3], 5), (1.0, [0, 10], 3)],
)
def test_acceptance_equals_the_sequential_run(spark, share, targets, max_misses):
    phases = [[f"n{i}" for i in range(400)], [f"p{i}" for i in range(300)]]
    available = {k for p in phases for k in p if int(md5("a", k)[:4], 16) < share * 65536}
    cand = spark.createDataFrame([(k, i) for i, p in enumerate(phases) for k in p], "image_id string, phase int").repartition(3)
    avail = spark.createDataFrame([(k,) for k in available] or [("none",)], "image_id string")
    got = S.ordered_acceptance(cand, avail, targets, max_misses=max_misses).orderBy("pos").collect()
    assert [(r.image_id, r.phase, r.hit, r.pos, r.streak) for r in got] == sequential(phases, available, targets, max_misses)


def test_streak_runs_on_across_phases(spark):
    cand = spark.createDataFrame([(f"a{i}", 0) for i in range(3)] + [(f"b{i}", 1) for i in range(4)], "image_id string, phase int")
    none = spark.createDataFrame([], "image_id string")
    got = S.ordered_acceptance(cand, none, [5, 5], max_misses=5).collect()
    assert len(got) == 5 and max(r.streak for r in got) == 5


# -- splits -------------------------------------------------------------------


def test_whole_studies_leave_the_pool(spark):
    files = {"100": ["aaa", "bbb", "ccc"], "200": ["ddd", "eee"], "300": ["fff", "ggg"]}
    paths = [(f"pngs/pngs/{s}/ser1/IM_0000-ID_{i}.png",) for s, ids in files.items() for i in ids]
    listing = parse_listing(spark.createDataFrame(paths, "path string").repartition(4))
    excluded = spark.createDataFrame([("ID_ddd",), ("ID_ggg",)], "image_id string")
    assert {r.image_id for r in P.exclude_groups(listing, excluded).collect()} == {"ID_aaa", "ID_bbb", "ID_ccc"}


def test_study_with_most_rows(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("image_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("study_id"))
    out = P.exclude_groups(rows, spark.createDataFrame([("0",), ("1",)], "image_id string"))
    assert out.count() == 1999 and out.filter("study_id = 'hot'").count() == 0


def test_composite_exclusion_and_candidates(spark):
    index = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "patient int, slice int")
    used = spark.createDataFrame([(1, 2)], "patient int, slice int")
    assert sorted(map(tuple, P.exclude_rows(index, used).collect())) == [(1, 1), (2, 1)]
    left, right = spark.range(3).withColumnRenamed("id", "image_id"), spark.range(1, 5).withColumnRenamed("id", "image_id")
    assert P.candidates(left, right).count() == 2


def test_slice_numbers_start_at_one(spark):
    index = spark.createDataFrame([(1, 0), (1, 1), (1, 3), (1, 4), (9, 1)], "patient int, slice int")
    vols = spark.createDataFrame([(1, 3)], "patient int, n_slices int")
    assert {(r.patient, r.slice): r.valid for r in P.valid_slices(index, vols).collect()} == {(1, 0): False, (1, 1): True, (1, 3): True, (1, 4): False, (9, 1): False}


def test_alignment_leaves_nulls(spark):
    a = spark.createDataFrame([("x", 1, 0)], "image_file string, any_hemorrhage int, Fracture int")
    b = spark.createDataFrame([("y", 0)], "image_file string, any_hemorrhage int")
    got = {r.image_file: (r.Fracture, r.No_Hemorrhage) for r in P.align_sources(a, b).collect()}
    assert got == {"x": (0, 0), "y": (None, 1)}


def test_fidelity_of_a_greedy_sample(spark):
    pop = population(spark, [(False, 1, 0, 90), (False, 1, 1, 10)])
    greedy = pop.filter("IVH = 1")
    r = P.fidelity(greedy, pop, LABELS).first()
    assert r.total_variation == pytest.approx(0.9) and r.sample_multi_share == 1.0 and r.population_multi_share == pytest.approx(0.1)
    assert P.fidelity(pop, pop, LABELS).first().total_variation == 0


def test_overlap_counts(spark):
    a = spark.createDataFrame([(1, "p"), (2, "p")], "image int, patient string")
    b = spark.createDataFrame([(3, "p"), (4, "q")], "image int, patient string")
    assert {tuple(r) for r in P.overlap_counts(a, b, ["image", "patient"]).collect()} == {("image", 2, 2, 0), ("patient", 1, 2, 1)}


# -- long label lists ---------------------------------------------------------


def sparse_rows(spark, n=3000, labels=300, most=3):
    rng = np.random.default_rng(0)
    w = 1 / np.arange(1, labels + 1) ** 0.8
    rows = [(i, [f"l{x}" for x in rng.choice(labels, rng.integers(0, most + 1), replace=False, p=w / w.sum())]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, marks array<string>")


def deviations(rows, taken, n):
    """Rows away from the share, of the whole, each label and each pair."""
    off = {}
    for i, marks in rows:
        m = sorted(marks)
        for key in [(), *((a,) for a in m), *combinations(m, 2)]:
            off[key] = off.get(key, 0.0) + (i in taken) - n / len(rows)
    return off


def test_long_list_keeps_labels_and_pairs(spark):
    rows, df = sparse_rows(spark)
    got = [r.id for r in long_list_sample(df, 300, "marks", ["id"]).collect()]
    assert len(got) == len(set(got)) == 300
    off = deviations(rows, set(got), 300)
    labels, pairs = ([abs(v) for k, v in off.items() if len(k) == m] for m in (1, 2))
    assert len(labels) > 280 and max(labels) < 1.5 and sum(v >= 1 for v in labels) <= 3
    assert max(pairs) < 2 and sum(v >= 1 for v in pairs) < 0.01 * len(pairs)
    assert sorted(r.id for r in long_list_sample(df.repartition(5), 300, "marks", ["id"]).collect()) == sorted(got)


def test_long_list_sums_as_numpy_does():
    r = np.random.Generator(np.random.PCG64(4))
    for n in range(1, 300):
        terms = r.normal(size=n) * 10.0 ** r.integers(-4, 4, n)
        assert _total(terms.tolist()) == terms.sum()


def test_long_list_query_puts_the_orders_together_once(spark, tmp_path):
    items = [(o, o * 7 + i) for o in range(200) for i in range(o % 5 + 1)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    suite.QUERIES or suite.load()
    got = suite.QUERIES["long_list_sample"](spark, str(tmp_path))
    assert "collect_set" not in got._jdf.queryExecution().optimizedPlan().toString()
    counts = Counter(f"p{p % 300}" for _, p in {(o, p % 300) for o, p in items})
    assert {r.label: r.n for r in got.collect()} == counts


def test_long_list_in_blocks_and_edge_cases(spark):
    rows, df = sparse_rows(spark, 1500)
    got = [r.id for r in long_list_sample(df, 450, "marks", ["id"], block=300).collect()]
    assert abs(len(got) - 450) <= 3
    off = deviations(rows, set(got), 450)
    assert np.mean([abs(v) for k, v in off.items() if len(k) == 1]) < 1
    assert long_list_sample(df, 10_000, "marks", ["id"]).count() == 1500
    assert long_list_sample(df.limit(0), 10, "marks", ["id"]).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, ["a", None, "a"]), (4, ["a"])], "id long, marks array<string>")
    assert long_list_sample(odd, 2, "marks", ["id"]).count() == 2
    flags = spark.range(400).select("id", *[((F.col("id") % (i + 2)) == 0).cast("int").alias(f"f{i}") for i in range(20)])
    assert multilabel_sample(flags, 40, [f"f{i}" for i in range(20)], ["id"]).count() == 40


# -- staged acceptance, membership, order statistics --------------------------


def test_acceptance_probes_no_more_than_it_needs(spark):
    cand = spark.range(5000).select(F.col("id").cast("string").alias("image_id"), (F.col("id") % 2).cast("int").alias("phase"))
    stages, asked = [], []

    def lookup(keys):
        asked.append(keys.count())
        return keys.where(F.crc32("image_id") % 10 < 9)

    out = S.ordered_acceptance(cand, lookup, [40, 60], on_stage=lambda *x: stages.append(x))
    got = out.groupBy("phase").agg(F.sum("hit").alias("hits"), F.count("*").alias("n")).collect()
    assert {r.phase: r.hits for r in got} == {0: 40, 1: 60}
    assert sum(asked) == sum(n for _, n, _ in stages) < 600 < 5000
    whole = S.ordered_acceptance(cand, lookup(cand.select("image_id")), [40, 60])
    assert sorted(map(tuple, out.select("image_id", "pos", "streak").collect())) == sorted(map(tuple, whole.select("image_id", "pos", "streak").collect()))
    # a streak of misses ends the search before later ranges and phases are tried
    stages.clear()
    few = S.ordered_acceptance(cand, lambda keys: keys.limit(0), [40, 60], max_misses=20, on_stage=lambda *x: stages.append(x))
    assert few.count() == 20 and [p for p, *_ in stages] == [0]
    # nobody is there at all: every candidate is tried
    assert S.ordered_acceptance(cand, lambda keys: keys.limit(0), [40, 60]).count() == 5000


def test_bitmap_passes_every_member_and_few_others(spark):
    keys = spark.range(0, 3000, 3).select(F.col("id").cast("string").alias("k"))
    every = spark.range(30_000).select(F.col("id").cast("string").alias("k"), "id")
    bitmap = membership.key_bitmap(keys, "k")
    passed = {r.k for r in membership.may_be_in(every, "k", bitmap).select("k").collect()}
    assert {str(i) for i in range(0, 3000, 3)} <= passed and len(passed) < 1000 + 0.1 * 30_000
    assert membership.key_bitmap(keys, "k", limit_bytes=100) is None and membership.may_be_in(every, "k", None) is every
    assert membership.may_be_in(every, "k", membership.key_bitmap(keys.limit(0), "k")).count() == 0
    plan = membership.may_be_in(every, "k", bitmap)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_exclusion_scans_the_listing_twice(spark, tmp_path):
    spark.range(2000).select((F.col("id") % 50).cast("string").alias("study_id"), F.col("id").cast("string").alias("image_id")).write.parquet(str(tmp_path / "l"))
    listing = spark.read.parquet(str(tmp_path / "l"))
    ids = spark.createDataFrame([("7",), ("8",), ("nowhere",), (None,)], "image_id string")
    touched = P.touched_groups(listing, ids)
    assert sorted(r.study_id for r in touched.collect()) == ["7", "8"]
    out = P.exclude_groups(listing, ids, touched=touched)
    assert out.count() == 48 * 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(str(tmp_path / "l")) == 1 or plan.count("FileScan") == 2


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(4)
    parts = {
        "hot": rng.lognormal(0, 6, 4000), "one": [3.25], "ties": [1.0] * 900 + [2.0] * 901, "two": [1.0, 4.0], "big": [-1.7e308, 1.7e308, 0.0, 1e-300],
        None: rng.integers(-5, 5, 300).astype(float),
    }
    rows = [(g, float(v)) for g, vs in parts.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r.quantile for r in exact_quantile(df, ["g"], "v", q, few=50, buckets=16).collect()}
    assert got.keys() == parts.keys()
    for g, vs in parts.items():
        if g != "big" or q != 0.9:
            assert got[g] == pytest.approx(float(np.quantile(np.array(vs), q)), rel=1e-12)
    assert exact_quantile(df, [], "v", 0.5, few=50).first().quantile == pytest.approx(float(np.median([v for vs in parts.values() for v in vs])))


def test_no_task_holds_a_group_for_its_median(spark):
    df = spark.range(60_000).select(F.lit("all").alias("g"), (F.col("id") * 7919 % 60_013).cast("double").alias("v"))
    out = exact_quantile(df, ["g"], "v", few=100, buckets=64)
    assert out.first().quantile == pytest.approx(float(np.median([i * 7919 % 60_013 for i in range(60_000)])))
    assert "percentile" not in out._jdf.queryExecution().toString()
