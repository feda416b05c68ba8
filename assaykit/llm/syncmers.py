"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen when the smallest of its inner s-mers (by hash) is the first or the last:
the choice looks at the k-mer alone, so equal passages choose equal k-mers wherever they stand, at most
k - s positions apart. ``anchors`` keeps the positions; ``matches`` pairs the places of two texts that hold the
same anchor, and the likeness of two texts is the share of their anchors that so match, over all of them. The
``fingerprint`` column is the compact form that is stored: the WIDTH smallest distinct hashes.

Defined cases: a null or empty text has the empty fingerprint, like another empty one 1, like others 0; a text
shorter than k is one k-mer; the order of documents is descending doc_id, null last, rows repeated with one
doc_id by the hash of their texts, which also splits a doc_id or null that holds many rows; the last document is followed by the first; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import table, whole

K, S, WIDTH = 16, 8, 256
HEX = 10  # hex digits of a hash in the fingerprint
_B = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all n-grams, put together from those of powers of two."""
    out, done, power, width, base = None, 0, codes, 1, _B
    while True:
        if n & width:
            if out is None:
                out, done = power, width
            else:
                size = len(codes) - done - width + 1
                out = out[:size] * np.uint64(base) + power[done : done + size]
                done += width
        if done == n:
            return _mixed(out[: len(codes) - n + 1])
        size = len(codes) - 2 * width + 1
        power = power[:size] * np.uint64(base) + power[width : width + size]
        width, base = 2 * width, base * base % 2**64


def _window_min(x: np.ndarray, n: int) -> np.ndarray:
    out, w = x, 1
    while w < n:
        step = min(w, n - w)
        out = np.minimum(out[:-step], out[step:])
        w += step
    return out


def anchors(text: str | None, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions (code points) and hashes of the closed syncmers of a whole text."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(codes) < k:
        return np.zeros(1, np.int64), _grams(codes, len(codes))
    inner = _grams(codes, s)
    span = k - s + 1
    low = _window_min(inner, span)
    at = np.flatnonzero((inner[: len(low)] == low) | (inner[span - 1 :] == low))
    return at, _grams(codes, k)[at]


def firsts(found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors, ascending by hash, each with its first place."""
    h, i = np.unique(found[1], return_index=True)
    return found[0][i], h


def matches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Pairs of places at which two texts hold the same anchor, by place in ``a``; both as ``firsts`` gives them."""
    _, x, y = np.intersect1d(a[1], b[1], assume_unique=True, return_indices=True)
    pairs = np.column_stack([a[0][x], b[0][y]])
    return pairs[np.argsort(pairs[:, 0], kind="stable")]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The share of two texts' distinct anchors that match, 0 to 1."""
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1]))
    shared = len(matches(a, b))
    return shared / (len(a[1]) + len(b[1]) - shared)


def sketch(distinct: tuple[np.ndarray, np.ndarray], width: int = WIDTH) -> np.ndarray:
    return np.unique(distinct[1] >> np.uint64(64 - 4 * HEX))[:width]


def as_text(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").tobytes().hex()
    return "".join([raw[i + 16 - HEX : i + 16] for i in range(0, len(raw), 16)])


def fingerprints(docs: DataFrame, k: int = K, s: int = S, width: int = WIDTH) -> DataFrame:
    """``doc_id``, ``fingerprint`` and the anchors as ``positions`` and ``hashes`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [anchors(t, k, s) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].astype("Int64"),
                    "fingerprint": [as_text(sketch(firsts(f), width)) for f in found],
                    "positions": [p for p, _ in found],
                    "hashes": [h.view(np.int64) for _, h in found],
                }
            )

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fingerprint string, positions array<long>, hashes array<long>")


def in_order(docs: DataFrame) -> DataFrame:
    """Rows dealt into ranges of doc_id, each followed by a guest: the first row of the range after it.

    Ranges come from quantiles of the ids; a few numbers for each range reach the driver, eight ranges for
    each shuffle partition at most. An id that several quantiles name is split by the hash of its texts into
    as many ranges, and so are rows without id. Texts are shuffled once.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) or []
    bounds, times = np.unique(-np.array(cuts), return_counts=True)
    parts = np.append(times, [1, n])  # ranges at each bound, past the last one, and of the rows without id
    starts = np.cumsum(parts) - parts

    @F.pandas_udf("int")
    def bucket(x: pd.Series, tie: pd.Series) -> pd.Series:
        v = -x.to_numpy(dtype="float64", na_value=-np.inf)
        at = np.where(np.isinf(v), len(bounds) + 1, np.searchsorted(bounds, v))
        # rows of an id in descending order of the hash; greater ids come before them, in the first of its ranges
        down = ~(tie.to_numpy(dtype="int64").view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        inside = (down * parts[at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        own = np.append(bounds, [np.nan, np.inf])[at] == v
        return pd.Series((starts[at] + np.where(own, inside, 0)).astype("int32"))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("bucket", bucket("doc_id", "tie"))
    first = F.max(F.struct("doc_id", "tie")).alias("first")
    tops = sorted((r.bucket, r.first.doc_id, r.first.tie) for r in rows.groupBy("bucket").agg(first).collect())
    if not tops:
        return rows.withColumn("guest", F.lit(False))
    places = [(b, tops[(i + 1) % len(tops)][1], tops[(i + 1) % len(tops)][2]) for i, (b, _, _) in enumerate(tops)]
    heads = spark.createDataFrame(places, "home int, want long, want_tie long")
    guests = (
        rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("want")) & (F.col("tie") == F.col("want_tie")))
        .groupBy("home")
        .agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("tie").alias("tie"))
        .select("doc_id", "text", "tie", F.col("home").alias("bucket"), F.lit(True).alias("guest"))
    )
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    return every.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.desc("tie"))


def _edited(k: int, s: int, width: int):
    import hashlib

    def row(doc_id, text, own, following, next_anchors):
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        new = firsts(anchors(changed, k, s))
        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, as_text(sketch(own, width)), as_text(sketch(new, width)), likeness(own, new), likeness(own, next_anchors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # the row that waits for the one after it
        for pdf in batches:
            out = []
            for doc_id, text, bucket, guest in zip(pdf["doc_id"].astype("Int64"), pdf["text"], pdf["bucket"], pdf["guest"]):
                own = firsts(anchors(text, k, s))
                if last is not None and last[0] == bucket:
                    out.append(row(*last[1:], text, own))
                last = None if guest else (bucket, doc_id, text, own)
            if out:
                made = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
                yield made.assign(doc_id=pd.array([r[0] for r in out], "Int64"))

    return run


def edited_likeness(docs: DataFrame, k: int = K, s: int = S, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document."""
    return in_order(docs).select("doc_id", "text", "bucket", "guest").mapInPandas(
        _edited(k, s, width),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


QUERY = "op1_document_fingerprints"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
