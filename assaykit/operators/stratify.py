"""Multi-label stratification for long label lists: 2 ** L combinations can't be listed, those that occur can.

Rows are counted per combination that occurs. Each combination is sure of the whole part of its share; what is left over
is a 0 / 1 choice per combination, so that every label, every pair of labels and the whole come out within a row of
their shares as far as possible. That choice follows iterative stratification: combinations with the rarest label or pair
come first, and each takes the side that keeps the deviations of its labels and pairs least. Combinations that can lower a
deviation by changing sides do so afterwards, alone or, for labels, two at a time.

The table of left-over combinations is cut into blocks of bounded size. Each block has whole-numbered targets for its labels and
pairs, running totals rounded block by block, so that blocks are settled side by side and their sums still meet the shares.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.ordering import take_by_hash
from assaykit.session import cut_lineage

BLOCK = 20_000
LABEL_WEIGHT = 400.0  # a label's deviation beside a pair's
EFFORT = 16  # combinations tried per deviating label, and partners tried for each of their keys


def _cost(d: float) -> float:
    """Grows slowly up to a row's deviation, fast beyond."""
    a = abs(d)
    over = a - 0.9
    return a * a + 50 * (over * over) if over > 0 else a * a


def _total(terms: list[float]) -> float:
    """The sum, rounded as numpy rounds it, so that the ties between choices fall the same way: up to 128 terms in eight lanes."""
    n = len(terms)
    if n > 128:
        return float(np.add.reduce(terms))
    if n < 8:
        out, rest = 0.0, terms
    else:
        a, b, c, d, e, f, g, h = terms[:8]
        for i in range(8, n - n % 8, 8):
            a, b, c, d = a + terms[i], b + terms[i + 1], c + terms[i + 2], d + terms[i + 3]
            e, f, g, h = e + terms[i + 4], f + terms[i + 5], g + terms[i + 6], h + terms[i + 7]
        out, rest = ((a + b) + (c + d)) + ((e + f) + (g + h)), terms[n - n % 8 :]
    for t in rest:
        out += t
    return out


def settle(keys: Sequence[Sequence[int]], left: np.ndarray, off: np.ndarray, weight: np.ndarray, passes: int = 6) -> np.ndarray:
    """0 or 1 for each combination: ``left`` are their fractions, ``keys`` the labels and pairs they count for.

    ``off`` holds each key's deviation before anything is chosen; it is changed as choices are made. A combination has a
    few keys and choices come one after the other, so plain numbers are quicker here than arrays.
    """
    member: list[list[int]] = [[] for _ in off]
    for i, ks in enumerate(keys):
        for k in ks:
            member[k].append(i)
    support = list(map(len, member))
    x = [0] * len(keys)
    left, d, w = left.tolist(), off.tolist(), weight.tolist()
    cost = list(map(_cost, d))  # of each key as it is

    def gain(i: int, step: float) -> float:
        terms = []
        for k in keys[i]:
            a = abs(d[k] + step)
            over = a - 0.9
            terms.append(w[k] * ((a * a + 50 * (over * over) if over > 0 else a * a) - cost[k]))
        return _total(terms)

    def move(i: int, step: float) -> None:
        for k in keys[i]:
            d[k] += step
            cost[k] = _cost(d[k])

    def flip(i: int) -> None:
        step = 1 - 2 * x[i]
        x[i] += step
        move(i, step)

    def change(i: int) -> float:
        return gain(i, 1 - 2 * x[i])

    for i in sorted(range(len(keys)), key=lambda i: (min(support[k] for k in keys[i]), i)):
        x[i] = int(gain(i, 1 - left[i]) < gain(i, -left[i]))
        move(i, x[i] - left[i])
    for _ in range(passes):
        better = [i for i in range(len(keys)) if change(i) < -1e-9 and (flip(i) or True)]
        if not better:
            break
    for k in 2 * [k for k in range(len(d)) if abs(d[k]) >= 1 - 1e-9 and w[k] > 1]:
        if abs(d[k]) < 1 - 1e-9:
            continue
        side = int(d[k] < 0)
        for i in sorted((i for i in member[k] if x[i] != side), key=change)[:EFFORT]:
            alone = change(i)
            flip(i)
            if alone < -1e-9:
                break
            partners = {j for kk in keys[i] for j in member[kk][:EFFORT] if j != i}
            j = min(partners, key=change, default=None)
            if j is not None and alone + change(j) < -1e-9:
                flip(j)
                break
            flip(i)
    off[:] = d
    return np.array(x, float)


def _names(labels: Sequence[str]) -> list[str]:
    """What a combination counts for: the whole, its labels, its pairs."""
    return ["", *labels, *("\x1e".join(p) for p in combinations(labels, 2))]


def _settled(block: pd.DataFrame, goals: pd.DataFrame) -> pd.DataFrame:
    if block.empty:
        return pd.DataFrame({"combination": [], "extra": []})
    block = block.sort_values("combination", ignore_index=True)
    place = {name: i for i, name in enumerate(goals["name"])}
    keys = [[place[n] for n in _names(list(labels))] for labels in block["labels"]]
    held = [0.0] * len(place)
    for ks, r in zip(keys, block["left"].tolist()):
        for k in ks:
            held[k] += r
    off = np.array(held)
    weight = np.array([1.0 if "\x1e" in n else LABEL_WEIGHT for n in goals["name"]])
    weight[place[""]] *= 5
    x = settle(keys, block["left"].to_numpy(), off - goals["goal"].to_numpy(), weight)
    return pd.DataFrame({"combination": block["combination"], "extra": x.astype("int64")})


def combination_quotas(combos: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(combination, quota) for (combination, labels, n): shares of ``n`` rows, or of all if there are fewer."""
    combos = cut_lineage(combos)
    total = combos.agg(F.sum("n")).first()[0] or 0
    if not total:
        return combos.select("combination", F.lit(0).cast("long").alias("quota"))
    want = min(n, total)
    share = F.col("n").cast("decimal(38,0)") * F.lit(want).cast("decimal(38,0)")
    whole = combos.withColumn("__rest", (share % F.lit(total)).cast("long")).withColumn("__base", ((share - F.col("__rest")) / F.lit(total)).cast("long"))
    open_ = whole.where("__rest > 0")
    blocks = max(1, -(-open_.count() // block))
    dealt = open_.select("combination", "labels", "__rest", (F.col("__rest") / F.lit(float(total))).alias("left"), F.pmod(F.xxhash64("combination"), F.lit(blocks)).cast("int").alias("block"))

    pairs = F.flatten(F.transform("labels", lambda a, i: F.transform(F.slice("labels", i + 2, F.size("labels")), lambda b: F.concat(a, F.lit("\x1e"), b))))
    counted = dealt.select("block", F.explode(F.concat(F.array(F.lit("")), "labels", pairs)).alias("name"), "__rest")
    sums = counted.groupBy("block", "name").agg(F.sum("__rest").cast("decimal(38,0)").alias("r"))
    upto = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)  # a row a block
    near = lambda c: F.floor((c * 2 + F.lit(total)) / F.lit(2 * total)).cast("long")
    goals = sums.withColumn("s", F.sum("r").over(upto)).select("block", "name", (near(F.col("s")) - near(F.col("s") - F.col("r"))).alias("goal"))

    chosen = dealt.select("block", "combination", "labels", "left").groupBy("block").cogroup(goals.groupBy("block")).applyInPandas(_settled, "combination string, extra long")
    return whole.join(chosen, "combination", "left").select("combination", (F.col("__base") + F.coalesce("extra", F.lit(0))).alias("quota"))


def long_list_sample(df: DataFrame, n: int, present: str | Column, keys: Sequence[str], seed: int | str = 42, block: int = BLOCK) -> DataFrame:
    """``n`` rows with the shares that labels and pairs of labels have in ``df``.

    ``present`` is the array of a row's labels, in any order; null counts as no label. The whole comes first, then labels, then pairs. Where
    rows have few labels, nearly all are met within a row. Dense rows leave no such choice for every pair, and each further block may
    add a row to a label's deviation. The same rows come out however the input lies.
    """
    held = F.array_sort(F.array_distinct(F.coalesce(F.col(present) if isinstance(present, str) else present, F.array().cast("array<string>"))))
    rows = df.withColumn("__labels", F.array_compact(held)).withColumn("combination", F.array_join("__labels", "\x1f"))
    combos = rows.groupBy("combination").agg(F.first("__labels").alias("labels"), F.count("*").alias("n"))
    return take_by_hash(rows, combination_quotas(combos, n, block), ["combination"], keys, seed).drop("__labels", "combination")
