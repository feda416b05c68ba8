"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its features describe it and the lines beside it, so the chain sees neighbours
both in features and in transitions. Forward and backward passes give each line's probability of being
good; the mean weighted by line length is the document's, calibrated on the learning rows by a logistic
curve. Learning happens on the driver on a bounded sample of labelled rows, each of them whole: at most ``SAMPLE``
documents, chosen by hash, of at most ``LONGEST`` lines each and ``LINES`` together. Scoring reads all texts whole, in tasks.

Defined cases: a null or empty text is one empty line and gets that line's score; rows are independent, so
repeated rows get equal scores; a table without labels of both kinds to learn from gives every document 0.5;
a null doc_id counts as held out; an empty table gives an empty result; of the other columns none is an
input of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import released, stored, table, whole

SAMPLE, LONGEST, LINES = 3000, 512, 150_000
STEPS, RATE, RIDGE = 200, 0.1, 1e-3
OWN, FEATURES = 15, 33  # features of a line by itself; with those of its neighbours, the equality with the line before, two edges and a constant
_CLASSES = 9  # lower, upper, digit, space, point, mark, bar, symbol, other


def _char_classes() -> np.ndarray:
    out = np.full(0x3000, 8, np.uint8)
    for c in range(len(out)):
        x = chr(c)
        if x.islower():
            out[c] = 0
        elif x.isupper():
            out[c] = 1
        elif x.isdigit():
            out[c] = 2
        elif x.isspace():
            out[c] = 3
        elif x in ".,;:'\"-()":
            out[c] = 4
        elif x in "!?":
            out[c] = 5
        elif x in "|<>{}[]=/\\_~^":
            out[c] = 6
        elif not x.isalnum():
            out[c] = 7
    return out


_TABLE = _char_classes()


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x FEATURES) and lengths (at least 1) of the lines of a text."""
    lines = text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = _TABLE[np.minimum(codes, len(_TABLE) - 1)].astype(np.int64)
    line_of = np.cumsum(codes == 10)
    count = np.bincount(line_of * _CLASSES + kind, minlength=len(lines) * _CLASSES).reshape(len(lines), _CLASSES)[: len(lines)].astype(float)
    length = np.fromiter(map(len, lines), float, len(lines))
    share = count / np.maximum(1, length)[:, None]
    own = np.zeros((len(lines), OWN))
    own[:, :8] = share[:, :8]
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            own[i, 8] = len(set(words)) / n
            own[i, 9] = sum(map(eq, words, words[1:])) / n
            own[i, 10] = sum(map(len, words)) / n / 10
            own[i, 11] = line.rstrip()[-1] in ".!?"
    own[:, 12] = np.log1p(length) / 6
    own[:, 13] = length < 20
    own[:, 14] = share[:, 1] > 0.5
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    same = np.array([0.0] + [float(a == b) for a, b in zip(lines, lines[1:])])
    beside = (before + after) / 2
    edges = np.zeros((len(lines), 2))
    edges[0, 0] = edges[-1, 1] = 1
    return np.hstack([own, beside, same[:, None], edges])[:, : FEATURES], np.maximum(1, length)


def _order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences longest first, their first rows, and how many are still running at each step."""
    rank = np.argsort(-lengths, kind="stable")
    first = (np.cumsum(lengths) - lengths)[rank]
    running = np.searchsorted(-lengths[rank], -np.arange(1, lengths.max() + 1), side="right")
    return rank, first, running


def marginals(emit: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, expected transitions (2 x 2), and the sum of log partition functions.

    ``emit`` is the score of "good" over "bad" per line, ``move`` the transition scores; sequences lie one
    after the other. All sequences advance together, so a step costs one array operation.
    """
    _, first, running = _order(lengths)
    steps = len(running)
    psi = np.column_stack([np.zeros(len(emit)), emit])
    top = psi.max(1, keepdims=True)
    psi = np.exp(psi - top)
    m = np.exp(move)
    alpha, scale = np.zeros_like(psi), np.zeros(len(emit))
    for t in range(steps):
        rows = first[: running[t]] + t
        a = psi[rows] if t == 0 else (alpha[rows - 1] @ m) * psi[rows]
        scale[rows] = a.sum(1)
        alpha[rows] = a / scale[rows][:, None]
    beta = np.ones_like(psi)
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        rows = first[: running[t + 1]] + t
        onward = psi[rows + 1] * beta[rows + 1] / scale[rows + 1][:, None]
        beta[rows] = onward @ m.T
        pairs += (alpha[rows].T @ onward) * m
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    return gamma[:, 1], pairs, float(np.log(scale).sum() + top.sum())


class Model:
    def __init__(self, weights, move, mean, spread, curve):
        self.weights, self.move, self.mean, self.spread, self.curve = weights, move, mean, spread, curve

    def line_scores(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        emit = np.clip(((x - self.mean) / self.spread) @ self.weights[:-1] + self.weights[-1], -30, 30)
        return marginals(emit, self.move, lengths)[0]

    def score(self, texts: list[str]) -> np.ndarray:
        """The quality of each document: the calibrated mean of its lines' P(good), weighted by length."""
        made = [line_features(t) for t in texts]
        lengths = np.array([len(w) for _, w in made])
        good = self.line_scores(np.vstack([x for x, _ in made]), lengths)
        weight = np.concatenate([w for _, w in made])
        starts = np.cumsum(lengths) - lengths
        mean = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        return 1 / (1 + np.exp(-(self.curve[0] * (mean - 0.5) + self.curve[1])))


def fit(docs: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> Model:
    """Maximum conditional likelihood by Adam; a document's label holds for its lines. Both labels weigh alike."""
    lengths = np.array([len(w) for _, w, _ in docs])
    x = np.vstack([f for f, _, _ in docs])
    label = np.repeat([y for _, _, y in docs], lengths).astype(float)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    inner = np.ones(len(x), bool)
    inner[np.cumsum(lengths) - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[at].astype(int), label[at + 1].astype(int)), 1)
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, move = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs, _ = marginals(np.clip(x @ w, -30, 30), move, lengths)
        gradient = np.concatenate([x.T @ (label - good), (seen - pairs).ravel()]) / len(x) - ridge * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model = Model(theta[:-4], theta[-4:].reshape(2, 2), mean, spread, (1.0, 0.0))
    good = model.line_scores(np.vstack([f for f, _, _ in docs]), lengths)
    weight = np.concatenate([w for _, w, _ in docs])
    starts = np.cumsum(lengths) - lengths
    p = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts) - 0.5
    y = np.array([y for _, _, y in docs], float)
    a, b = 8.0, 0.0
    for _ in range(50):  # Newton's steps of a ridged logistic fit
        q = 1 / (1 + np.exp(-(a * p + b)))
        g = np.array([((y - q) * p).sum() - 1e-2 * a, (y - q).sum() - 1e-2 * b])
        v = q * (1 - q)
        h = np.array([[(v * p * p).sum() + 1e-2, (v * p).sum()], [(v * p).sum(), v.sum() + 1e-2]])
        da, db = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + da, b + db
    model.curve = (a, b)
    return model


def held_out():
    """Rows that are never learnt from: those whose remainder is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model of ``labels.quality`` from at most ``sample`` whole documents; None where one kind of label is missing."""
    known = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", whole().alias("text")).join(F.broadcast(known), "doc_id")
    chosen = chosen.where(F.size(F.split("text", "\n")) <= LONGEST)

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [line_features(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "quality": pdf["quality"],
                    "n": [len(w) for _, w in made],
                    "x": [x.astype(np.float32).tobytes() for x, _ in made],
                    "w": [w.astype(np.float32).tobytes() for _, w in made],
                }
            )

    # rows repeated with one doc_id would pass the bound: one of them is enough to learn from
    features = chosen.mapInPandas(run, "doc_id long, quality int, n int, x binary, w binary")
    features = features.groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("quality", "n")], F.min(F.struct("x", "w")).alias("f"))
    # at most ``sample`` rows: whole documents in the order of their hashes, as long as their lines fit together
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    features = stored(features, "line-features")
    fits = features.select("doc_id", F.sum("n").over(order).alias("lines")).where(F.col("lines") <= LINES).select("doc_id")
    rows = sorted(features.join(fits, "doc_id").collect(), key=lambda r: r.doc_id)
    got = [(np.frombuffer(r.f.x, np.float32).reshape(-1, FEATURES).astype(float), np.frombuffer(r.f.w, np.float32).astype(float), r.quality) for r in rows]
    return fit(got) if len({y for *_, y in got}) == 2 else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score``; the whole text is read."""
    if model is None:
        return docs.withColumn("score", F.lit(0.5))

    @F.arrow_udf("double")
    @released
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            # of a batch's texts 256 at a time are Python strings
            parts = [model.score(texts.slice(i, 256).to_pylist()) for i in range(0, len(texts), 256)]
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn("score", quality(whole()))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, sample))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those that the classifier rejects; all columns stay."""
    name = "__quality"
    scored = score(docs.withColumnRenamed("score", name) if "score" in docs.columns else docs, learn(docs, labels, sample))
    kept = scored.where(F.col("score") >= 0.5).drop("score")
    return kept.withColumnRenamed(name, "score") if "score" in docs.columns else kept


QUERY = "op3_quality_classifier"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
