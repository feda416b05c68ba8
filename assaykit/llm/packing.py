"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; full pieces are sequences of their own. The other
pieces are dealt by hash into groups of bounded size. A group is packed on several islands, each a task of its
own with its own seed: individuals start from best-fit decreasing orders; crossover injects whole well-filled
bins of one parent into another, drops the duplicates and best-fits the displaced pieces. Between epochs the
best packing of each island migrates to its neighbour. The best island's well-filled bins stay; the pieces
of its other bins are dealt anew, into groups of the same size, as long as that closes half of them or saves
bins. All bins of a level are closed as they are when one group is left, when no packing has fewer, or when
dealing anew has ceased to pay: a group never grows, however few pieces fit together.

Defined cases: a null or empty text is the end token alone; repeated rows are documents of their own; ties go
by row number; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import released, remembered, stored, table, whole

CAPACITY, END = 4096, 1
GROUP, ISLANDS, EPOCHS, POPULATION, CROSSINGS = 2000, 2, 2, 4, 6
SPARE = 48  # a bin with at most so many free tokens is well filled
GAIN = 0.01  # a level that leaves most pieces open must save this share of their bins for another one to follow
CACHE = 150_000  # words of a generation; a worker remembers two

# How the tokenizer file splits a normalised text. Words between white space are split alone.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Texts with anything else (other scripts, control characters, special tokens) go to the tokenizer whole. Of these
# characters, composition changes none and lower-casing looks at each alone, so words can be encoded by the
# tokenizer's model one by one.
PLAIN = "[\\t-\\r -\\u007e\\u00a0-\\u012f\\u0131-\\u024f\\u2010-\\u2027\\u20ac]*"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Token ids as little-endian bytes. Words are remembered for two generations: those that come again outlive the others."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.split, self.plain = regex.compile(SPLIT), re.compile(PLAIN)
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.old_pieces.get(piece)
            if ids is None:
                tokens = self.whole.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
                ids = array("I", [t.id for t in tokens]).tobytes()
            self.pieces[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self._piece(word[:-1]) + self._piece(word[-1])
        return b"".join(map(self._piece, self.split.findall(word)))

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not self.plain.fullmatch(text):
            ids = self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids
            return np.array(ids, "<u4").tobytes()
        if len(self.words) > CACHE:
            self.old_words, self.words = self.words, {}
        if len(self.pieces) > CACHE:
            self.old_pieces, self.pieces = self.pieces, {}
        words = text.lower().split()
        found = list(map(self.words.get, words))
        if None in found:
            held, old = self.words, self.old_words
            for i, ids in enumerate(found):
                if ids is None:
                    w = words[i]
                    ids = held.get(w)  # the same word, earlier in this text
                    if ids is None:
                        ids = old.get(w)
                        ids = held[w] = self._word(w) if ids is None else ids
                    found[i] = ids
        return b"".join(found)


def _encoder(path: str) -> Encoder:
    return remembered(("packing", path), lambda: Encoder(path))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(row, doc_id, piece, start, length, ids_crc32): the pieces of every row."""
    path = path or tokenizer_path()
    last = np.array([end], "<u4").tobytes()
    names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part, out = batch.slice(lo, 500), []
                # of a batch's texts one at a time is a Python string
                for row, doc_id, text in zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), part.column("text")):
                    ids = encode(text.as_py()) + last
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        out.append((row, doc_id, i, at // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, piece int, start long, length long, ids_crc32 long")


Bins = list[list[int]]  # item numbers by bin


def best_fit(order: list[int], size: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Put items in this order into the fullest bin they fit."""
    bins = [list(b) for b in bins or []]
    free = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(free, (size[i], -1))
        if at == len(free):
            bins.append([i])
            insort(free, (capacity - size[i], len(bins) - 1))
        else:
            room, k = free.pop(at)
            bins[k].append(i)
            insort(free, (room - size[i], k))
    return bins


def crossed(giver: Bins, taker: Bins, size: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """A child of ``taker`` that has some of the well-filled bins of ``giver`` whole."""
    full = [b for b in giver if capacity - sum(size[i] for i in b) <= SPARE]
    if not full:
        return taker
    given = [full[k] for k in rng.permutation(len(full))[: max(1, len(full) // 3)]]
    inside = {i for b in given for i in b}
    kept = [b for b in taker if inside.isdisjoint(b)]
    loose = [i for b in taker if not inside.isdisjoint(b) for i in b if i not in inside]
    loose.sort(key=lambda i: (-size[i], i))
    return best_fit(loose, size, capacity, given + kept)


def fitness(bins: Bins, size: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(size[i] for i in b) / capacity) ** 2 for b in bins)


def fewest(total: int, large: int, capacity: int) -> int:
    """No packing has fewer bins: the tokens need room, and of the pieces over half a bin no two share one."""
    return max(-(-total // capacity), large)


def evolve(start: list[Bins], size: list[int], capacity: int, seed: int, population: int = POPULATION, crossings: int = CROSSINGS) -> Bins:
    """The best packing after some crossovers; stops at the least number of bins there can be."""
    rng = np.random.Generator(np.random.PCG64(seed))
    least = fewest(sum(size), sum(2 * s > capacity for s in size), capacity)
    people = list(start)
    while len(people) < population:
        noise = rng.random(len(size)) * 0.2 * (len(people) > 0) + 1
        people.append(best_fit(sorted(range(len(size)), key=lambda i: (-size[i] * noise[i], i)), size, capacity))
        if len(people[-1]) == least:
            return people[-1]
    rank = lambda b: fitness(b, size, capacity)
    for _ in range(crossings):
        people.sort(key=rank, reverse=True)
        if len(people[0]) == least:
            break
        a, b = rng.permutation(len(people))[:2]
        people[-1] = max(people[-1], crossed(people[a], people[b], size, capacity, rng), key=rank)
    return max(people, key=rank)


_STATE = "grp long, island int, row long, piece int, length long, bin int"


def _epoch(capacity: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "piece"], kind="stable").reset_index(drop=True)
        grp, island = int(pdf["grp"].iloc[0]), int(pdf["island"].iloc[0])
        parents = []
        for _, one in pdf.groupby("parent"):
            if one["bin"].iloc[0] >= 0:
                numbered = one.reset_index(drop=True)
                parents.append([list(map(int, g)) for g in numbered.groupby("bin").indices.values()])
        items = pdf[pdf["parent"] == pdf["parent"].min()].reset_index(drop=True)
        size = items["length"].tolist()
        mask = (1 << 63) - 1
        best = evolve(parents, size, capacity, (seed * 1_000_003 + grp * 1009 + island) & mask)
        bins = np.empty(len(size), np.int32)
        for k, b in enumerate(best):
            bins[b] = k
        return items.assign(bin=bins)[["grp", "island", "row", "piece", "length", "bin"]]

    return run


def pack_groups(items: DataFrame, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """(grp, row, piece, length, bin, fill): the best island's packing of each group."""
    each = F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
    state = items.select("grp", each.alias("island"), F.lit(0).alias("parent"), "row", "piece", "length", F.lit(-1).alias("bin"))
    for epoch in range(epochs):
        packed = stored(state.groupBy("grp", "island").applyInPandas(_epoch(capacity, seed + epoch), _STATE), "epoch")
        own = packed.withColumn("parent", F.lit(0))
        moved = packed.withColumn("island", ((F.col("island") + 1) % islands).cast("int")).withColumn("parent", F.lit(1))
        state = own.unionByName(moved)
    bins = packed.groupBy("grp", "island", "bin").agg(F.sum("length").alias("fill"))
    score = bins.groupBy("grp", "island").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("fill") / capacity, 2)).alias("q"))
    best = score.groupBy("grp").agg(F.min(F.struct("n", -F.col("q"), "island")).alias("b")).select("grp", F.col("b.island").alias("island"))
    won = packed.join(best, ["grp", "island"])
    return won.join(bins, ["grp", "island", "bin"]).select("grp", "row", "piece", "length", "bin", "fill")


def placed(packed: DataFrame, level: int, groups: int) -> DataFrame:
    """(row, piece, sequence_id, offset) of whole bins; numbers differ between bins, groups and levels."""
    order = Window.partitionBy("grp", "bin").orderBy("row", "piece")
    name = F.lit(level << 56) + F.col("bin").cast("long") * groups + F.col("grp")
    return packed.select("row", "piece", name.alias("sequence_id"), (F.sum("length").over(order) - F.col("length")).alias("offset"))


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    group: int = GROUP,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    seed: int = 11,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece."""
    cut = stored(pieces(docs, path, capacity), "pieces")
    full = cut.where(F.col("length") == capacity).select("row", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = cut.where(F.col("length") < capacity).select("row", "piece", "length")
    done, level, count, before = full, 0, left.count(), None
    while count:
        groups = -(-count // group)
        items = left.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed + level), "row", "piece"), F.lit(groups)))
        packed = stored(pack_groups(items, capacity, islands, epochs, seed + level), "packed")
        is_open, is_large = F.col("fill") < capacity - SPARE, F.col("length") * 2 > capacity
        each = packed.groupBy("grp", "bin").agg(F.first("fill").alias("fill"), F.count("*").alias("n"), F.count(F.when(is_large, 1)).alias("large"))
        of_open = lambda n: F.coalesce(F.sum(F.when(is_open, n)), F.lit(0))
        bins, total, large, open_bins, rest = each.agg(F.count("*"), F.sum("fill"), F.sum("large"), of_open(F.lit(1)), of_open(F.col("n"))).first()
        idle = before is not None and 2 * rest > count and bins > (1 - GAIN) * before[1]
        if groups == 1 or bins == fewest(total, large, capacity) or idle:
            # the open bins of the level before hold the same pieces
            better = before is not None and before[1] < bins
            done = done.unionByName(before[0] if better else placed(packed, level, groups))
            break
        done = done.unionByName(placed(packed.where(~is_open), level, groups))
        left = packed.where(is_open).select("row", "piece", "length")
        before, count, level = (placed(packed.where(is_open), level, groups), open_bins), rest, level + 1
    return cut.join(done, ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERY = "op9_best_fit_packing"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
