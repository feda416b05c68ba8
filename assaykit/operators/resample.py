"""Bootstrap intervals, paired significance and the permutation null.

F1 depends on a run's rows only through its confusion cells, and drawing n rows
with replacement is one multinomial draw over the cells. A resample therefore costs
the same for 150 rows and for 10^10: Spark reduces the rows to cells, and tasks
draw from the cells. The keyed forms draw row by row from md5 instead; they are
reproducible in any engine and serve as the check of the default.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.keys import unique_by
from assaykit.sources.results import INGEST, last_per_key
from assaykit import fixed_values as V
from assaykit.functions.labels import outcome
from assaykit.operators.metrics import DEFAULT_CLASSES, evaluate, ratio
from assaykit.operators.sampling import random_per_query
from assaykit.session import cut_lineage


_WIDE = 1000.0  # standard deviation beyond which a binomial is drawn as a normal
_STRETCH = 1 << 16  # draws made at once
_GROUPS = 256  # groups that share a draw's md5
_TASK_DRAWS, _TASKS = 1 << 17, 4000  # draws a task, and the most tasks


def _rng(*key: object) -> np.random.Generator:
    digest = hashlib.md5("|".join(map(str, key)).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest, "big"))


def _f1(tp: np.ndarray, fp: np.ndarray, fn: np.ndarray) -> np.ndarray:
    """2pr / (p + r) without the intermediate ratios; 0 where there is no true positive."""
    return np.divide(2.0 * tp, 2.0 * tp + fp + fn, out=np.zeros(len(tp)), where=tp > 0)


def interval_positions(n_boot: int, lo: float, hi: float) -> tuple[int, int]:
    """Zero-based order statistics of an interval; the upper one is clamped."""
    return int(lo * n_boot), min(int(hi * n_boot), n_boot - 1)


def bootstrap_ci(
    counts: DataFrame, by: Sequence[str] = ("run", "class"), n_boot: int = V.N_BOOT, seed: int = 42, alpha: float = V.ALPHA
) -> DataFrame:
    """Append f1_lo and f1_hi to a table with n, tp, fp, fn — one row per group.

    Rows a policy drops are still drawn: they sit in the rest cell.
    """
    by = list(by)
    at_lo, at_hi = interval_positions(n_boot, alpha / 2, 1 - alpha / 2)
    schema = T.StructType(
        [*counts.schema.fields, T.StructField("f1_lo", T.DoubleType()), T.StructField("f1_hi", T.DoubleType())]
    )

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lo, hi = [], []
            for *key, n, tp, fp, fn in pdf[[*by, "n", "tp", "fp", "fn"]].itertuples(index=False):
                share = np.array([tp, fp, fn, n - tp - fp - fn]) / n
                cells = _rng(seed, *key).multinomial(n, share, size=n_boot)
                f1 = np.sort(_f1(cells[:, 0], cells[:, 1], cells[:, 2]))
                lo.append(f1[at_lo])
                hi.append(f1[at_hi])
            yield pdf.assign(f1_lo=lo, f1_hi=hi)

    return counts.filter(F.col("n") > 0).mapInPandas(draw, schema)


def _quantiles_of_binomial(n: int, p: float, u: np.ndarray) -> np.ndarray:
    """The least k whose cumulative probability under Binomial(n, p) reaches u."""
    if n <= 0 or p <= 0:
        return np.zeros(len(u), dtype=np.int64)
    if p >= 1:
        return np.full(len(u), n, dtype=np.int64)
    spread = math.sqrt(n * p * (1 - p))
    if spread > _WIDE:
        # the exact table would be longer than it is worth: a normal quantile is right to a millionth of the range
        normal = NormalDist()
        z = np.array([normal.inv_cdf(min(max(x, 2.0**-53), 1 - 2.0**-53)) for x in u])
        return np.clip(np.rint(n * p + spread * z), 0, n).astype(np.int64)
    first, last = max(0, math.floor(n * p - 12 * spread) - 30), min(n, math.ceil(n * p + 12 * spread) + 30)
    k = np.arange(first, last + 1)
    logs = np.array([math.lgamma(x + 1.0) + math.lgamma(n - x + 1.0) for x in k.tolist()])
    cdf = np.cumsum(np.exp(math.lgamma(n + 1.0) - logs + k * math.log(p) + (n - k) * math.log(1 - p)))
    return np.minimum(first + np.searchsorted(cdf, u, side="left"), n)


def cell_draws(n: int, cells: Sequence[int], key: str, n_boot: int) -> np.ndarray:
    """(n_boot, len(cells)): multinomial draws as a chain of binomials; draw b of cell i is decided by md5(key|b|i)."""
    left, mass = np.full(n_boot, n, dtype=np.int64), n
    out = np.zeros((n_boot, len(cells)), dtype=np.int64)
    for i, c in enumerate(cells):
        u = np.array([int(hashlib.md5(f"{key}|{b}|{i}".encode()).hexdigest()[:13], 16) for b in range(n_boot)]) / 2.0**52
        for m in np.unique(left):
            at = np.flatnonzero(left == m)
            out[at, i] = _quantiles_of_binomial(int(m), c / mass if mass else 0.0, u[at])
        left, mass = left - out[:, i], mass - c
    return out


def cell_ci(
    counts: DataFrame, by: Sequence[str] = ("run", "class"), n_boot: int = V.N_BOOT, seed: int | str = 42, alpha: float = V.ALPHA
) -> DataFrame:
    """``counts`` with f1_lo and f1_hi, from draws that any engine can repeat.

    As ``bootstrap_ci``, but the multinomial is a chain of binomials, each the inverse distribution function at a number from md5. The cost
    goes by the cells of a group, not by its rows.
    """
    by = list(by)
    at_lo, at_hi = interval_positions(n_boot, alpha / 2, 1 - alpha / 2)
    schema = T.StructType([*counts.schema.fields, T.StructField("f1_lo", T.DoubleType()), T.StructField("f1_hi", T.DoubleType())])

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = []
            for *key, n, tp, fp, fn in pdf[[*by, "n", "tp", "fp", "fn"]].itertuples(index=False):
                name = "|".join(str(x) for x in (seed, *key) if x is not None)
                f1 = np.sort(_f1(*cell_draws(int(n), [int(tp), int(fp), int(fn)], name, n_boot).T))
                ends.append((f1[at_lo], f1[at_hi]))
            yield pdf.assign(f1_lo=[a for a, _ in ends], f1_hi=[b for _, b in ends])

    return counts.filter(F.col("n") > 0).mapInPandas(draw, schema)


def _draws(name: str, first: int, last: int) -> np.ndarray:
    """Draws first..last-1 as ``hash_long(key_hash(…))`` gives them: the leading 60 bits of md5(name|j)."""
    digests = b"".join([hashlib.md5(f"{name}|{j}".encode()).digest() for j in range(first, last)])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64)


def keyed_bootstrap(
    counts: DataFrame, by: Sequence[str] = ("run", "class"), n_boot: int = V.N_BOOT, seed: int | str = 42
) -> DataFrame:
    """(by…, b, tp, fp, fn, f1): every resample, drawn row by row from md5(seed|b|j).

    The drawn position falls into a cell by the cells' cumulative sizes, so the rows
    themselves are not needed. A draw's md5 is the same for all groups and is made once for
    up to ``_GROUPS`` of them. Draws are made and counted inside tasks; a shuffle
    carries three counters per resample, group and stretch.
    """
    by = list(by)
    a = F.coalesce("tp", F.lit(0))
    b = F.coalesce(F.col("tp") + F.col("fp"), a)
    c = F.coalesce(F.col("tp") + F.col("fp") + F.col("fn"), b)
    groups = cut_lineage(
        counts.filter(F.col("n") > 0).select(
            F.struct(*by).alias("by"), *[x.cast("long").alias(name) for name, x in (("n", F.col("n")), ("a", a), ("b", b), ("c", c))]
        )
    )
    slots = max(1, -(-groups.count() // _GROUPS))
    stretches = (
        groups.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_STRETCH).cast("long"))))
        .groupBy("__from", F.pmod(F.xxhash64("by"), F.lit(slots)).alias("__slot"))
        .agg(F.collect_list(F.struct("by", "n", "a", "b", "c")).alias("__groups"))
    )
    # a few bytes stand for much work: a stated number of tasks, or adaptive execution lets all rows share one
    draws = stretches.agg(F.sum(F.least(F.array_max("__groups.n") - F.col("__from"), F.lit(_STRETCH)))).first()[0] or 0
    tasks = min(1 + draws * n_boot // _TASK_DRAWS, _TASKS)
    dealt = stretches.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).repartition(tasks, "__from", "__slot", "b")
    group = T.StructField("group", dealt.schema["__groups"].dataType.elementType)
    schema = T.StructType([T.StructField("b", T.IntegerType()), group, *[T.StructField(x, T.LongType()) for x in ("tp", "fp", "fn")]])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                first, resample = batch["__from"][at].as_py(), batch["b"][at].as_py()
                held = batch["__groups"].slice(at, 1).flatten()
                n, a, b, c = (held.field(x).to_numpy() for x in ("n", "a", "b", "c"))
                drawn = _draws(f"{seed}|{resample}", first, min(first + _STRETCH, int(n.max())))
                cells = np.zeros((len(n), 3), dtype=np.int64)
                for size in np.unique(n):
                    place = np.sort(drawn[: size - first] % size)
                    same = n == size
                    cells[same] = np.searchsorted(place, np.stack([a[same], b[same], c[same]], axis=1))
                cells = np.diff(cells, axis=1, prepend=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), resample, "int32")), held, *map(pa.array, cells.T)], schema.names)

    resampled = dealt.select("b", "__from", "__groups").mapInArrow(draw, schema).groupBy(
        *[F.col("group.by")[x].alias(x) for x in by], "b"
    ).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    two_tp = 2.0 * F.col("tp")
    return resampled.withColumn("f1", ratio(two_tp, two_tp + F.col("fp") + F.col("fn")))


def keyed_ci(resamples: DataFrame, by: Sequence[str], n_boot: int, alpha: float = V.ALPHA) -> DataFrame:
    """Order statistics of keyed resamples; a group is ``n_boot`` numbers."""
    at_lo, at_hi = interval_positions(n_boot, alpha / 2, 1 - alpha / 2)
    values = F.array_sort(F.collect_list("f1"))
    return resamples.groupBy(*by).agg(
        F.get(values, F.lit(at_lo)).alias("f1_lo"), F.get(values, F.lit(at_hi)).alias("f1_hi")
    )


def paired_cells(
    pairs: DataFrame, gt: str, pred_a: str, pred_b: str, by: Sequence[str] = (), policy: str = "negative"
) -> DataFrame:
    """(by…, a, b, n): rows by the outcome of both methods, at most 16 cells per group."""
    return pairs.groupBy(
        *by, outcome(F.col(gt), F.col(pred_a), policy).alias("a"), outcome(F.col(gt), F.col(pred_b), policy).alias("b")
    ).agg(F.count(F.lit(1)).alias("n"))


def paired_bootstrap(cells: DataFrame, by: Sequence[str], n_boot: int = V.N_BOOT, seed: int = 42) -> DataFrame:
    """F1 of both methods, difference (b - a), 95 % interval and two-sided p-value.

    Both methods are scored on the same resample; the p-value doubles the share of
    resamples on the side of no improvement and is clamped at one.
    """
    by = list(by)
    at_lo, at_hi = interval_positions(n_boot, 0.025, 0.975)
    schema = T.StructType(
        [cells.schema[c] for c in by]
        + [T.StructField("n", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("f1_a", "f1_b", "diff", "ci_lo", "ci_hi", "p_value")]
    )

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["a", "b"])
        sizes = pdf["n"].to_numpy()
        n = int(sizes.sum())
        drawn = np.vstack([sizes[None, :], _rng(seed, *key).multinomial(n, sizes / n, size=n_boot)])

        def f1(side: str) -> np.ndarray:
            return _f1(*(drawn[:, (pdf[side] == o).to_numpy()].sum(axis=1) for o in ("tp", "fp", "fn")))

        a, b = f1("a"), f1("b")
        diff = b - a
        spread = np.sort(diff[1:])
        wrong = np.sum(spread <= 0) if diff[0] > 0 else np.sum(spread >= 0)
        row = [*key, n, a[0], b[0], diff[0], spread[at_lo], spread[at_hi], min(1.0, 2 * wrong / n_boot)]
        return pd.DataFrame([row], columns=[f.name for f in schema])

    return cells.groupBy(*by).applyInPandas(draw, schema)


def significance_report(
    manifest: DataFrame, results_a: DataFrame, results_b: DataFrame, gt: str = V.ANY, pred: str = "pred_any_hem",
    key: str = "image_file", policy: str = "negative", n_boot: int = V.N_BOOT, seed: int = 42, label_a: str = "a", label_b: str = "b",
) -> DataFrame:
    """Score two runs on the keys they share with the manifest, as one row with what was compared.

    Of records repeated with a key the last one counts, as in ``last_per_key``; without any order they raise.
    """
    one = lambda df: last_per_key(df, (key,)) if {"seq", INGEST} & set(df.columns) else unique_by(df, key)
    pairs = three_way(unique_by(manifest, key), one(results_a), one(results_b), gt, pred, key)
    cells = paired_cells(pairs.withColumn("__pair", F.lit("a|b")), gt, "pred_a", "pred_b", ["__pair"], policy)
    row = paired_bootstrap(cells, ["__pair"], n_boot, seed).drop("__pair")
    named = {"label_a": label_a, "label_b": label_b, "uncertain_policy": policy}
    return row.select(*[F.lit(v).alias(k) for k, v in named.items()], "*")


def three_way(
    manifest: DataFrame, results_a: DataFrame, results_b: DataFrame, gt: str = V.ANY, pred: str = "pred_any_hem", key: str = "image_file"
) -> DataFrame:
    """Keys present in the manifest and in both runs."""
    a = results_a.select(key, F.col(pred).alias("pred_a"))
    b = results_b.select(key, F.col(pred).alias("pred_b"))
    return manifest.select(key, gt).join(a, key).join(b, key)


def interval_overlaps(intervals: DataFrame, within: Sequence[str], name: str, lo: str = "f1_lo", hi: str = "f1_hi") -> DataFrame:
    """Pairs of settings inside a group and whether their intervals overlap (a report table)."""
    left = intervals.select(*within, F.col(name).alias("a"), F.col(lo).alias("lo_a"), F.col(hi).alias("hi_a"))
    right = intervals.select(*within, F.col(name).alias("b"), F.col(lo).alias("lo_b"), F.col(hi).alias("hi_b"))
    return (
        left.join(right, list(within))
        .filter(F.col("a") < F.col("b"))
        .withColumn("overlap", (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a")))
    )


def score_with_ci(
    pairs: DataFrame, by: Sequence[str] = ("run",), classes: Mapping[str, tuple[str, str]] = DEFAULT_CLASSES,
    policy: str = "negative", n_boot: int = V.N_BOOT, seed: int = 42, alpha: float = V.ALPHA,
) -> DataFrame:
    """``evaluate`` with a bootstrap interval on every row."""
    return bootstrap_ci(evaluate(pairs, by, classes, policy), [*by, "class"], n_boot, seed, alpha)


# -- permutation null ---------------------------------------------------------


def match_counts(queries: DataFrame, pool: DataFrame, labels: str = "labels") -> DataFrame:
    """(m, n_query): how many queries share a label with exactly m pool rows.

    Only label *sets* meet: both sides are first reduced to their distinct sets.
    """
    q = queries.groupBy(F.array_sort(labels).alias("ql")).agg(F.count(F.lit(1)).alias("nq"))
    p = pool.groupBy(F.array_sort(labels).alias("pl")).agg(F.count(F.lit(1)).alias("np"))
    # one row per (set, label) on both sides turns the overlap test into an equi-join
    pairs = (
        q.select("ql", F.explode("ql").alias("label"))
        .join(p.select("pl", "np", F.explode("pl").alias("label")), "label")
        .select("ql", "pl", "np")
        .distinct()
    )
    matched = pairs.groupBy("ql").agg(F.sum("np").alias("m"))
    return (
        q.join(matched, "ql", "left")
        .groupBy(F.coalesce("m", F.lit(0)).alias("m"))
        .agg(F.sum("nq").alias("n_query"))
    )


def permutation_null(
    queries: DataFrame, pool: DataFrame, k: int = V.HIT_RATE_K, n_trials: int = V.N_TRIALS, seed: int = 42, labels: str = "labels"
) -> DataFrame:
    """(trial, hit_rate): hit rate of k random pool rows per query, ``n_trials`` times.

    For a query sharing a label with m of N pool rows the matches are hypergeometric;
    queries with equal m are exchangeable, so one multinomial over 0..k serves them
    all. The work depends on label sets and trials, not on queries or pool rows.
    """
    total = pool.agg(F.count(F.lit(1)).alias("n")).scalar()
    groups = match_counts(queries, pool, labels).withColumn("pool_n", total)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m, c, size in pdf[["m", "n_query", "pool_n"]].itertuples(index=False):
                take = min(k, int(size))
                p = hypergeometric(int(size), int(m), take)
                cells = _rng(seed, int(m)).multinomial(int(c), p, size=n_trials)
                yield pd.DataFrame(
                    {"trial": np.arange(n_trials), "matched": cells @ np.arange(take + 1), "n_query": int(c)}
                )

    return (
        groups.mapInPandas(draw, "trial long, matched long, n_query long")
        .groupBy("trial")
        .agg((F.sum("matched") / (F.sum("n_query") * F.lit(float(k)))).alias("hit_rate"))
    )


def hypergeometric(size: int, marked: int, take: int) -> np.ndarray:
    """P(x marked among ``take`` drawn without replacement), x = 0..take."""
    p = np.zeros(take + 1)
    p[0] = 1.0
    for i in range(take):
        x = np.arange(i + 1)
        hit = np.clip((marked - x) / (size - i), 0.0, 1.0)
        step = np.zeros(take + 1)
        step[1 : i + 2] += p[: i + 1] * hit
        step[: i + 1] += p[: i + 1] * (1.0 - hit)
        p = step
    return p / p.sum()


def keyed_permutation_null(
    queries: DataFrame, pool: DataFrame, k: int, n_trials: int, seed: int | str = 42, query_id: str = "query_id",
    pool_id: str = "pool_id", labels: str = "labels",
) -> DataFrame:
    """The same null with explicit draws: k pool positions per (trial, query)."""
    trials = queries.select(query_id, F.col(labels).alias("__ql")).withColumn(
        "trial", F.explode(F.sequence(F.lit(0), F.lit(n_trials - 1)))
    )
    trials = trials.withColumn("__key", F.concat_ws("|", "trial", query_id))
    drawn = random_per_query(trials, pool, k, "__key", pool_id, seed, carry=[labels])
    hits = drawn.join(trials, "__key").groupBy("trial").agg(
        F.count_if(F.arrays_overlap("__ql", labels)).alias("n_matched"), F.count_distinct(query_id).alias("n_query")
    )
    return hits.select("trial", (F.col("n_matched") / (F.col("n_query") * F.lit(float(k)))).alias("hit_rate"))


def null_verdict(real: DataFrame, null: DataFrame, percentile: float = V.NULL_PERCENTILE) -> DataFrame:
    """One row: real hit rate, null mean, null percentile (linear), passed."""
    spread = null.agg(
        F.avg("hit_rate").alias("null_mean"),
        F.percentile("hit_rate", F.lit(percentile / 100.0)).alias("null_threshold"),
    ).select(F.struct("null_mean", "null_threshold").alias("s")).scalar()
    return real.select(
        F.col("hit_rate").alias("real_hit_rate"),
        spread["null_mean"].alias("null_mean"),
        spread["null_threshold"].alias("null_threshold"),
        (F.col("hit_rate") >= spread["null_threshold"]).alias("passed"),
    )
