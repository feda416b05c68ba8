"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

A text is cut by the tokenizer's pattern and each cut is encoded by itself, as tiktoken does. Bytes are mapped to
Latin-1, so that an Aho-Corasick automaton over the vocabulary finds every token of two bytes or more that stands in
a cut; single bytes need no search. One pass of it leaves the longest token at each place. Encoding goes from left
to right and takes the longest token there; a token may follow another only if merging their bytes in rank order
would leave the border between them (``Merges.fits``, remembered for each pair). Where no token fits, the last one is
given up and the next shorter token, a prefix of it, is tried; a place from which the rest can't be encoded is marked
and never tried again. So each place is tried with each of its tokens once: time is linear in the length of a cut, and
the result is that of merging the pair with the lowest rank again and again.

A worker loads the vocabulary once, from a file that every executor has at ``path``. It remembers at most REMEMBERED
pairs, and then starts anew; cuts for two generations of that many, so that those that come again outlive the
others. A text needs memory in proportion to its length.

Defined cases: null and empty texts have no ids; repeated rows stay; a null doc_id stays null; an empty table gives an
empty result; strings of special tokens are ordinary text. Other columns are not looked at, unless ``encode`` is told to carry them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import table, whole

REMEMBERED = 400_000
SHORT = 64  # longer cuts are not remembered


class Merges:
    """What the vocabulary's merges allow: each token's last merge, its next shorter prefix, and which pairs may meet."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = list(map(len, self.token))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.single = [ranks.get(bytes([b]), 0) for b in range(256)]
        self.shorter = [self._prefix(t) for t in self.token]
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int] | None] = []
        self.known: dict[tuple[int, int], bool] = {}
        # a token's last merge joins two tokens of lower rank, so tokens are settled in rank order
        for rank in range(len(self.token)):
            halves = self._last_merge(rank)
            self.halves.append(halves)
            if halves:
                self.merged[halves] = rank
        self.known.clear()

    def _prefix(self, token: bytes) -> int | None:
        """The longest token that is a proper prefix."""
        for n in range(len(token) - 1, 0, -1):
            if (found := self.ranks.get(token[:n])) is not None:
                return found
        return None

    def _last_merge(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; none for a single byte."""
        left = self.shorter[rank]
        while left is not None:
            right = self.ranks.get(self.token[rank][self.length[left] :])
            if right is not None and left < rank and right < rank and self._stays(left, right):
                return left, right
            left = self.shorter[left]
        return None

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two adjacent tokens; remembered."""
        pair = (left, right)
        held = self.known.get(pair)
        if held is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            held = self.known[pair] = self._stays(left, right)
        return held

    def _stays(self, left: int, right: int) -> bool:
        """Undo the merges of both sides, latest first, looking for one that would have crossed the border before.

        ``before`` is the rank of the merge undone last: the pieces now at the border existed until then, so a
        merge of both with a lower rank would have come first. On equal ranks the left side merges first.
        """
        before = len(self.token)
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < before:
                return False
            a, b = self.halves[left] if left < len(self.halves) else None, self.halves[right] if right < len(self.halves) else None
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                # the border's merge, further left, comes before this one where both have one rank
                before, right = right + 1, b[0]

    def encode(self, cut: bytes) -> list[int]:
        if (one := self.ranks.get(cut)) is not None:
            return [one]
        longest = list(map(self.single.__getitem__, cut))
        length, shorter, fits, known = self.length, self.shorter, self.fits, self.known.get
        for end, rank in self.automaton.iter(cut.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank  # ends ascend, so the longest comes last
        dead = bytearray(len(cut) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not dead[end] and (not out or known((out[-1], token)) or fits(out[-1], token)):
                out.append(token)
                if end == len(cut):
                    return out
                at, token = end, longest[end]
                continue
            while (less := shorter[token]) is None:
                # nothing fits here: give up the token before, which then is tried again in shorter forms
                dead[at] = 1
                token = out.pop()
                at -= length[token]
            token = less


class Cuts(dict):
    """Packed ids of each cut, remembered for two generations: those that come again outlive the others."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.old: dict[str, bytes] = {}

    def __missing__(self, cut: str) -> bytes:
        ids = self.old.get(cut)
        if ids is None:
            ids = np.array(self.merges.encode(cut.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(cut) <= SHORT:
            if len(self) >= REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[cut] = ids
        return ids


class Codec:
    """Text to ids and back for one rank file and pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.merges = Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.find = regex.compile(pattern).findall
        self.cuts = Cuts(self.merges)

    def packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cuts.__getitem__, self.find(text)))

    def bytes_of(self, packed: bytes) -> bytes:
        return b"".join(map(self.merges.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker, however many tasks it runs."""
    return Codec(path, pattern)


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The ``carry`` columns and ``ids``: each text's ids as little-endian unsigned 32-bit integers, one binary value."""
    rows = docs.select(*carry, whole(text).alias(ids))
    schema = docs.select(*carry, F.lit(b"").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            made = pa.array([own.packed(t) for t in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), made], [*carry, ids])

    return rows.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",), out: str = "bytes") -> DataFrame:
    """The ``carry`` columns and ``out``: the bytes that ids stand for. Ids may end inside a character, so these need not be UTF-8."""
    rows = encoded.select(*carry, F.coalesce(ids, F.lit(b"")).alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            made = pa.array([own.bytes_of(x) for x in batch.column(out).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), made], [*carry, out])

    return rows.mapInArrow(run, rows.schema)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of ids and of the bytes decoded from them: one row per document, nothing but digests leaves the task."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, digests, back = [], [], []
            for text in batch.column("text"):
                ids = own.packed(text.as_py())
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(own.bytes_of(ids)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(run, schema)


QUERY = "op13_byte_bpe"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), *_vocabulary())
