import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assaykit.functions.labels import binarise
from assaykit.operators import metrics as M
from assaykit.operators import reports as P
from assaykit.operators import resample as R
from assaykit.operators.keys import unique_by
from assaykit.plans.evaluation import retrieval_verdict, run_state, state_health, state_methods, state_missed, state_scores, summarise_runs
from suite import reports

GT = {"IPH": [1, 1, 0, 1, 0], "IVH": [0, 1, 0, 1, 1], "SAH": [0, 0, 1, 0, 0]}
PRED = {"IPH": [1, 0, 1, 1, 0], "IVH": [0, 1, 0, 0, 1], "SAH": [1, 0, 1, 0, 0]}
CLASSES = {k: (f"g_{k}", f"p_{k}") for k in GT}


def hand_example(spark):
    rows = [("r", *[GT[k][i] for k in GT], *[PRED[k][i] for k in GT]) for i in range(5)]
    schema = "run string, " + ", ".join(f"g_{k} int" for k in GT) + ", " + ", ".join(f"p_{k} int" for k in GT)
    return spark.createDataFrame(rows, schema)


def test_hand_calculated_scores(spark):
    per_class = M.evaluate(hand_example(spark), classes=CLASSES)
    got = {r["class"]: r for r in per_class.collect()}
    assert {k: (r.tp, r.fp, r.fn) for k, r in got.items()} == {"IPH": (2, 1, 1), "IVH": (2, 0, 1), "SAH": (1, 1, 0)}
    assert [round(got[k].f1, 4) for k in GT] == [0.6667, 0.8, 0.6667]
    assert round(M.macro_f1(per_class).first().macro_f1, 4) == 0.7111


def test_policies(spark):
    rows = spark.createDataFrame([(1,), (0,), (-1,), (None,)], "v int")
    for policy, want in (("negative", [1, 0, 0, 0]), ("positive", [1, 0, 1, 0]), ("ignore", [1, 0, None, 0])):
        assert [r.x for r in rows.select(binarise(F.col("v"), policy).alias("x")).collect()] == want
    with pytest.raises(ValueError):
        binarise(F.lit(1), "maybe")


def test_empty_denominators_are_zero(spark):
    df = spark.createDataFrame([("r", 0, 0)], "run string, g int, p int")
    r = M.evaluate(df, classes={"c": ("g", "p")}).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def counts(spark, n, tp, fp, fn):
    return spark.createDataFrame([("r", "c", n, tp, fp, fn)], "run string, class string, n long, tp long, fp long, fn long")


def row_bootstrap(n, tp, fp, fn, n_boot, seed):
    """Rows resampled one by one."""
    rng = np.random.default_rng(seed)
    cells = np.repeat([0, 1, 2, 3], [tp, fp, fn, n - tp - fp - fn])
    out = []
    for _ in range(n_boot):
        c = np.bincount(rng.choice(cells, n), minlength=4)
        out.append(2 * c[0] / (2 * c[0] + c[1] + c[2]) if c[0] else 0.0)
    return np.sort(out)


def test_interval_agrees_with_row_resampling(spark):
    r = R.bootstrap_ci(counts(spark, 150, 60, 20, 25)).first()
    f1 = row_bootstrap(150, 60, 20, 25, 4000, 1)
    assert r.f1_lo <= 120 / 165 <= r.f1_hi
    assert abs(r.f1_lo - f1[100]) < 0.02 and abs(r.f1_hi - f1[3900]) < 0.02


def test_keyed_interval_agrees_with_default(spark):
    c = counts(spark, 150, 60, 20, 25)
    keyed = R.keyed_ci(R.keyed_bootstrap(c, n_boot=1000), ["run", "class"], 1000).first()
    default = R.bootstrap_ci(c).first()
    assert abs(keyed.f1_lo - default.f1_lo) < 0.025 and abs(keyed.f1_hi - default.f1_hi) < 0.025


def test_keyed_draws_are_shared_by_groups_and_spread_over_tasks(spark, monkeypatch):
    sizes = {("r", "c"): (40, 9, 8, 7), ("r", None): (25, 0, 3, 4), (None, "d"): (7, 7, 0, 0), ("s", "d"): (0, 0, 0, 0)}
    c = spark.createDataFrame([(*k, *v) for k, v in sizes.items()], "run string, class string, n long, tp long, fp long, fn long")
    want = {}
    for key, (n, *cells) in sizes.items():
        for b in range(6 if n else 0):
            at = [int(hashlib.md5(f"5|{b}|{j}".encode()).hexdigest()[:15], 16) % n for j in range(n)]
            ends = np.cumsum([0, *cells])
            want[*key, b] = tuple(sum(lo <= x < hi for x in at) for lo, hi in zip(ends, ends[1:]))
    for stretch, groups in ((R._STRETCH, R._GROUPS), (10, 1)):
        monkeypatch.setattr(R, "_STRETCH", stretch)
        monkeypatch.setattr(R, "_GROUPS", groups)
        rows = R.keyed_bootstrap(c, n_boot=6, seed=5).collect()
        assert {(r.run, r["class"], r.b): (r.tp, r.fp, r.fn) for r in rows} == want
    monkeypatch.setattr(R, "_TASK_DRAWS", 60)
    tasks = R.keyed_bootstrap(c, n_boot=6, seed=5).select(F.spark_partition_id())
    assert "REPARTITION_BY_NUM" in tasks._jdf.queryExecution().toString()  # adaptive execution leaves these tasks as they are


def test_interval_is_the_same_under_repartitioning(spark):
    pairs = hand_example(spark)
    a = R.score_with_ci(pairs, classes=CLASSES).orderBy("class").collect()
    b = R.score_with_ci(pairs.repartition(5), classes=CLASSES).orderBy("class").collect()
    assert a == b


def test_order_statistics():
    assert R.interval_positions(2000, 0.025, 0.975) == (50, 1950)
    assert R.interval_positions(10, 0.0, 1.0) == (0, 9)


def paired(spark, gt, a, b, **options):
    rows = spark.createDataFrame([("p", *x) for x in zip(gt, a, b)], "pair string, g int, a int, b int")
    return R.paired_bootstrap(R.paired_cells(rows, "g", "a", "b", ["pair"]), ["pair"], **options).first()


def test_paired_floor_against_strong(spark):
    gt = [1, 0] * 10
    floor, strong = [0] * 20, [1, 0, 1, 0, 1, 0, 1, 0, 1, 0] + [0] * 10
    r = paired(spark, gt, floor, strong)
    assert r.f1_a == 0 and r.f1_b > 0 and r["diff"] > 0 and r.ci_lo <= r["diff"] <= r.ci_hi and r.p_value < 0.05
    same = paired(spark, gt, strong, strong)
    assert same["diff"] == 0 and same.p_value >= 0.05 and same.n == 20


def test_significance_drops_keys_missing_in_a_run(spark):
    keys = [f"img{i}" for i in range(1, 7)]
    manifest = spark.createDataFrame(list(zip(keys, [1, 1, 0, 1, 0, 1])), "image_file string, any_hemorrhage int")
    a = spark.createDataFrame([(k, 0) for k in keys[:5]], "image_file string, pred_any_hem int")
    b = spark.createDataFrame(list(zip(keys[:5], [1, 1, 0, 1, 0])), "image_file string, pred_any_hem int")
    r = R.significance_report(manifest, a, b).first()
    assert (r.n, r.f1_a, r.f1_b, r["diff"]) == (5, 0.0, 1.0, 1.0)


def label_sets(spark, sets, name):
    return spark.createDataFrame([(i, s) for i, s in enumerate(sets)], f"{name} long, labels array<string>")


def test_hypergeometric_is_exact():
    p = R.hypergeometric(10, 4, 3)
    assert np.allclose(p, [20 / 120, 60 / 120, 36 / 120, 4 / 120])
    assert np.allclose(R.hypergeometric(3, 3, 3), [0, 0, 0, 1])


def test_null_agrees_with_explicit_draws(spark):
    rng = random.Random(3)
    names = ["a", "b", "c", "d"]
    q = [rng.sample(names, rng.randint(1, 2)) for _ in range(60)]
    p = [rng.sample(names, rng.randint(1, 3)) for _ in range(50)]
    null = [r.hit_rate for r in R.permutation_null(label_sets(spark, q, "query_id"), label_sets(spark, p, "pool_id"), 5, 600).collect()]
    brute = [
        np.mean([sum(bool(set(s) & set(p[i])) for i in rng.sample(range(len(p)), 5)) / 5 for s in q]) for _ in range(600)
    ]
    assert len(null) == 600 and all(0 <= x <= 1 for x in null)
    assert abs(np.mean(null) - np.mean(brute)) < 0.01 and abs(np.percentile(null, 95) - np.percentile(brute, 95)) < 0.015


def test_match_counts(spark):
    q = label_sets(spark, [["a"], ["a", "b"], ["z"], []], "query_id")
    p = label_sets(spark, [["a"], ["b"], ["b", "a"], ["c"]], "pool_id")
    assert {(r.m, r.n_query) for r in R.match_counts(q, p).collect()} == {(2, 1), (3, 1), (0, 2)}


def labelled_axes(spark, signal, seed):
    """Fixed orthogonal directions, one per label, or labels dealt to these directions at random."""
    keys = ["IPH", "IVH", "SAH", "EDH", "SDH"]
    deal = np.random.default_rng(seed)

    def side(name, count):
        rows = []
        for i in range(count):
            axis = i % len(keys)
            vector = [0.02 * ((i * 7 + j * 3) % 5) for j in range(16)]
            vector[3 * axis] = 1.0
            size = float(np.linalg.norm(vector))
            rows.append((i, [x / size for x in vector], [keys[axis if signal else int(deal.integers(len(keys)))]]))
        return spark.createDataFrame(rows, f"{name} long, embedding array<float>, labels array<string>")

    return side("query_id", 100), side("pool_id", 100)


@pytest.mark.parametrize("signal, passed", [(1, True), (0, False)])
def test_verdict_on_clustered_and_noise_vectors(spark, signal, passed):
    q, p = labelled_axes(spark, signal, 4)
    r = retrieval_verdict(q, p, n_trials=300).first()
    assert r.passed is passed
    assert not passed or r.real_hit_rate > r.null_mean


def test_summary_of_runs(spark):
    manifest = spark.createDataFrame([("a", 1, 1, 0, 0, 0, 0), ("b", 0, 0, 0, 0, 0, 0)], "image_file string, any_hemorrhage int, IPH int, IVH int, SAH int, EDH int, SDH int")
    results = spark.createDataFrame(
        [(r, k, p, p, 0, 0, 0, 0, False, True) for r, k, p in (("x", "a", 1), ("x", "b", 0), ("x", "zzz", 1), ("y", "a", 0))],
        "run string, image_file string, pred_any_hem int, pred_IPH int, pred_IVH int, pred_SAH int, pred_EDH int, pred_SDH int, refused boolean, parsed boolean",
    )
    got = {r.run: r for r in summarise_runs(results, manifest).collect()}
    assert got["x"].n == 2 and got["x"].any_hemorrhage.f1 == 1.0 and got["x"].macro_f1 == 0.2
    assert got["y"].missed.n_missed == 1 and got["y"].missed.missed_rate == 1.0 and set(got["y"].per_subtype) == {"IPH", "IVH", "SAH", "EDH", "SDH"}


def test_unique_by(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert sorted(map(tuple, unique_by(df, "k", "last", "v").collect())) == [("a", 2), ("b", 1)]
    assert unique_by(df, "k", "keep").count() == 3
    with pytest.raises(PySparkException, match="duplicate key"):
        unique_by(df, "k").collect()
    with pytest.raises(PySparkException, match="duplicate key"):
        unique_by(df, "k").select("v").collect()
    assert unique_by(df.filter("v = 1"), "k").count() == 2


def test_markdown_line(spark):
    table = spark.createDataFrame(
        [("D", "M", 150, 0.575, 0.479, 0.663, 0.5, 0.7, 0.25, 10, 40, 0.0, 0.02)],
        "dataset string, method string, n long, f1 double, f1_lo double, f1_hi double, precision double, recall double, missed_rate double, n_missed long, missed_of long, parse_failure_rate double, refusal_rate double",
    )
    assert P.markdown_rows(table).first().line == "| D | M | 150 | 0.575 | [0.479, 0.663] | 0.500 | 0.700 | 25.0% (10/40) | 0.0% | 2.0% |"


def test_comparison_lines_resample_row_by_row(spark, monkeypatch):
    flags = [(str(i), *f) for i, f in enumerate([(1, 1)] * 31 + [(0, 1)] * 11 + [(1, 0)] * 17 + [(0, 0)] * 24)]
    pairs = spark.createDataFrame(
        [("base", k, g, *[0] * 5, p, *[0] * 5, False, True) for k, g, p in flags],
        "run string, image_file string, any_hemorrhage int, IPH int, IVH int, SAH int, EDH int, SDH int, pred_any_hem int, pred_IPH int, pred_IVH int, "
        "pred_SAH int, pred_EDH int, pred_SDH int, refused boolean, parsed boolean",
    )
    monkeypatch.setattr(reports, "_state", lambda *_: run_state(pairs))
    line = {r.method: r.line for r in reports.comparison_markdown(spark, "").collect()}["No context"]
    f1 = []
    for b in range(200):  # rows in the order tp, fp, fn, rest
        at = [int(hashlib.md5(f"42|{b}|{j}".encode()).hexdigest()[:15], 16) % 83 for j in range(83)]
        tp, wrong = sum(x < 31 for x in at), sum(31 <= x < 59 for x in at)
        f1.append(2 * tp / (2 * tp + wrong) if tp else 0.0)
    lo, hi = (sorted(f1)[i] for i in (5, 195))
    assert f"| 0.689 | [{lo:.3f}, {hi:.3f}] |" in line


def test_gate_audit_passes_only_without_errors(spark):
    df = spark.createDataFrame([("answer", "YES"), ("refuse", "no")], "expected string, answer string")
    assert P.gate_audit(P.gate_outcomes(df)).first().ok
    bad = df.union(spark.createDataFrame([("refuse", "yes")], df.schema))
    r = P.gate_audit(P.gate_outcomes(bad)).first()
    assert not r.ok and r.n_false_pass == 1 and r.false_refusal_rate == 0


# -- intervals by cells, one state per run ------------------------------------


def slow_quantile(n, p, u):
    total = 0.0
    for k in range(n + 1):
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= u:
            return k
    return n


def test_binomial_quantiles():
    u = np.random.default_rng(1).random(200)
    for n, p in [(1, 0.5), (7, 0.2), (40, 0.9), (200, 0.03), (0, 0.4), (5, 0.0), (5, 1.0)]:
        got = R._quantiles_of_binomial(n, p, u)
        want = [0 if n == 0 or p == 0 else n if p == 1 else slow_quantile(n, p, x) for x in u]
        assert got.tolist() == want
    # a run of any size costs the same, and keeps mean and spread
    big = R._quantiles_of_binomial(10**10, 0.3, np.random.default_rng(2).random(4000))
    assert abs(big.mean() - 3e9) < 4 * (2.1e9**0.5) / 4000**0.5 and abs(big.std() / 2.1e9**0.5 - 1) < 0.05


def test_cell_intervals_agree_with_the_other_resamplers(spark):
    c = counts(spark, 150, 60, 20, 25)
    cells, default = R.cell_ci(c).first(), R.bootstrap_ci(c).first()
    assert abs(cells.f1_lo - default.f1_lo) < 0.02 and abs(cells.f1_hi - default.f1_hi) < 0.02
    again = R.cell_ci(c.repartition(3)).first()
    assert (again.f1_lo, again.f1_hi) == (cells.f1_lo, cells.f1_hi)
    drawn = R.cell_draws(150, [60, 20, 25], "k", 2000)
    assert np.abs(drawn.mean(axis=0) - [60, 20, 25]).max() < 0.6 and (drawn.sum(axis=1) <= 150).all()
    assert not R.cell_draws(10, [0, 0, 0], "k", 5).any() and (R.cell_draws(10, [10, 0, 0], "k", 5)[:, 0] == 10).all()


def test_reports_scan_the_pairs_once(spark, tmp_path):
    labels = ["IPH", "IVH"]
    rows = [(f"r{i % 2}", str(i), i % 2, i % 3 == 0, True, ["structured", "fallback"][i % 5 == 0], i % 2, 0, i % 2, 1) for i in range(60)]
    names = "run string, image_file string, pred_any_hem int, refused boolean, parsed boolean, method string, pred_IPH int, pred_IVH int, IPH int, IVH int"
    spark.createDataFrame(rows, names).withColumn("any_hemorrhage", F.lit(1)).write.parquet(str(tmp_path / "p"))
    state = run_state(spark.read.parquet(str(tmp_path / "p")), labels=labels)
    for df in (state_scores(state, labels=labels), state_health(state), state_missed(state, labels=labels), state_methods(state)):
        assert "FileScan" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["run"]: r["method_counts"] for r in state_methods(state).collect()} == {"r0": {"structured": 24, "fallback": 6}, "r1": {"structured": 24, "fallback": 6}}
    scores = {(r["run"], r["class"]): (r.tp, r.fp, r.fn) for r in state_scores(state, labels=labels).collect()}
    assert scores[("r1", "IPH")] == (30, 0, 0) and scores[("r0", "IVH")] == (0, 0, 30)
