"""Jaccard self-join of documents on five-word shingles by rare-first prefix filtering.

1. Documents with equal shingle sets form a class; only classes are joined.
2. Shingles are ordered rare first by a frequency table of fixed size (2**20 counters over the whole
   corpus). The order only has to be one and the same everywhere; exact counts are not needed.
3. Two sets can reach the threshold only if their prefixes in that order share a shingle: prefixes are
   shuffled by shingle, and only shingles of two or more classes stay.
4. Every class is verified against one pivot, the most central class it shares most prefix shingles with, if these
   are as many as linked sets share. Links give components. Pairs inside one component need no further look, since only components are asked.
5. All pairs of different components that share a prefix shingle early enough (positional filter), are of similar length and
   share as many prefix shingles as linked sets must (count filter) are candidates, verified once: the suffix filter first, then the whole sets.

Shingles are 64-bit hashes, classes 128-bit hashes of sorted sets. Frequent shingles are dealt out by
(shingle, salt), the number of salts following from the frequency table.

Defined cases: a document without words (null or empty text too) has an empty set and is linked with
nothing; fewer than five words are one shingle; rows that share a doc_id but not the text are told apart, and linked
only by their texts; a null doc_id counts as the largest, and a component of null ids alone has the name null; rows without
words are named by their own doc_id; an empty table gives an empty result. Rows are known by 64-bit hashes of doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from assaykit.llm.common import released, remembered, spread_join, stored, table

WORDS, NUM, DEN = 5, 3, 4  # shingle length; linked when the Jaccard index is at least NUM / DEN
SLOTS, PART = 1 << 20, 1 << 12  # counters of the frequency table, and how many travel in a row
SALT = 0xFFFF  # the bits of a token that hold its salt
HOT = 50_000  # classes of a frequent shingle that one task takes
REMEMBER = 1 << 20  # classes a task remembers as handed on already
HUB = 32  # texts that are held against one copy of a hub's
FLUSH = 1 << 17  # prefix shingles that a task hands on at once
REMEMBER_WORDS = 1 << 17  # words whose hashes a worker remembers
NOBODY = (1 << 63) - 1  # stands for a null doc_id

_M = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


class _WordHashes(dict):
    """64-bit hashes of words; a worker remembers those of short words and forgets all when it has too many."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= REMEMBER_WORDS:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.frombuffer(hashlib.blake2b(b"\x00".join(words), digest_size=8, person=b"short").digest(), "<u8").copy()
    h = np.fromiter(map(remembered("jaccard", _WordHashes).__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        part = h[i : len(h) - n + 1 + i] * np.uint64(_M[i % 5] + 2 * (i // 5))
        out ^= (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(i)
        out *= np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def class_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def short_key(cls: bytes) -> int:
    """What stands for a class in shuffles; classes that share one are told apart when texts are verified."""
    return int.from_bytes(cls[:8], "big", signed=True)


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(40)).astype(np.int64) & (SLOTS - 1)


def required(a, b):
    """The least intersection of sets of sizes a and b at the threshold: ceil(t / (1 + t) (a + b))."""
    return -(-(NUM * (a + b)) // (NUM + DEN))


_DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int32()), ("cls", pa.binary()), ("key", pa.int64()), ("part", pa.int32()), ("counts", pa.binary())]
)


@released
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, then this task's share of the frequency table. Of a batch's texts one at a time is a Python string."""
    counts = np.zeros(SLOTS, np.int32)
    waiting, held = [], 0  # slots still to be counted: many texts are counted at once
    for batch in batches:
        sizes, classes, keys = [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py())
            waiting.append(_slot(s))
            held += len(s)
            if held >= SLOTS:
                counts += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype(np.int32)
                waiting, held = [], 0
            sizes.append(len(s))
            classes.append(class_of(s) if len(s) else None)
            keys.append(short_key(classes[-1]) if len(s) else None)
        n = len(sizes)
        made = [batch.column("doc_id"), batch.column("mark"), sizes, classes, keys, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, _DIGESTS)], schema=_DIGESTS)
    if held:
        counts += np.bincount(np.concatenate(waiting), minlength=SLOTS).astype(np.int32)
    if counts.any():
        parts = [counts[i : i + PART].tobytes() for i in range(0, SLOTS, PART)]
        n = len(parts)
        made = [pa.nulls(n, pa.int64()), [0] * n, [0] * n, pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), range(n), parts]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, _DIGESTS)], schema=_DIGESTS)


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(PART, np.int64)
    for c in pdf["counts"]:
        total += np.frombuffer(c, np.int32)
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def row_mark() -> Column:
    """Tells rows apart by doc_id and text; rows that are alike in both share it."""
    return F.xxhash64(F.coalesce("doc_id", F.lit(NOBODY)).cast("long"), "text")


def digests(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, mark, n, cls, key) of every row, and the frequency table: SLOTS 4-byte counters whatever the corpus."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_mark().alias("mark"), "text")
    both = stored(rows.mapInArrow(_digest, "doc_id long, mark long, n int, cls binary, key long, part int, counts binary"), "digests")
    table_rows = both.where("part is not null").groupBy("part").applyInPandas(_add, "part int, counts binary").collect()
    counts = np.zeros(SLOTS, np.int32)
    for r in table_rows:
        counts[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, np.int32)
    return both.where("part is null").select("doc_id", "mark", "n", "cls", "key"), counts


def prefix(shingles: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of a set, as many as any linked set must share one of, with their counts."""
    freq = counts[_slot(shingles)]
    order = np.lexsort((shingles, freq))
    n = len(shingles)
    keep = order[: n - -(-NUM * n // DEN) + 1]
    return shingles[keep], freq[keep]


def dealt(tokens: np.ndarray, freq: np.ndarray, cls: bytes) -> np.ndarray:
    """Tokens with a salt in their low 16 bits: 0, or for a frequent one 1 and up, by the class.

    Tokens that fall together for want of those bits only make candidates, which are verified.
    """
    salts = np.where(freq > HOT, 1 + int.from_bytes(cls[:4]) % (freq.astype(np.int64) // HOT + 1), 0)
    return (tokens & ~np.uint64(SALT)) | salts.astype(np.uint64)


def _prefixes(shared_counts):
    @released
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = shared_counts.value, set()
        keys, centrals, parts, held = [], [], [], 0

        def flush():
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(centrals, pa.int32()), tokens], ["key", "central", "tokens"])
            keys.clear(), centrals.clear(), parts.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                s = shingle_set(text.as_py())
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) < REMEMBER:
                    seen.add(c)
                p, f = prefix(s, counts)
                keys.append(short_key(c))
                centrals.append(int(1000 * np.log1p(counts[_slot(s)]).mean()))
                parts.append(dealt(p, f, c).view(np.int64))
                held += len(p)
                if held >= FLUSH:
                    yield flush()
                    held = 0
        if parts:
            yield flush()

    return rows


def shared_prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, pos, key, pivot): prefix shingles that stand in two classes or more.

    Three numbers travel for each prefix shingle: the salted shingle, the class, and how central the class is with the place.
    """
    spark = docs.sparkSession
    each = docs.select("text").mapInArrow(
        _prefixes(spark.sparkContext.broadcast(counts)), "key long, central int, tokens array<long>"
    )
    flat = each.select("key", "central", F.posexplode("tokens").alias("pos", "salted")).select(
        "salted", "key", F.shiftleft(F.col("central").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("spot")
    )
    w = Window.partitionBy("salted")
    mark = flat.select(
        "*",
        F.min("key").over(w).alias("least"),
        F.max("key").over(w).alias("most"),
        F.max(F.struct(F.shiftright("spot", 32), "key")).over(w)["key"].alias("pivot"),
    )
    # a frequent shingle is dealt over several salts: it is shared even where one salt holds a single class
    some = mark.where((F.col("least") != F.col("most")) | (F.col("salted").bitwiseAND(F.lit(SALT)) > 0))
    return stored(
        some.select(
            F.col("salted").bitwiseAND(F.lit(~SALT)).alias("token"),
            F.col("spot").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"),
            "key",
            "pivot",
        ),
        "prefixes",
    )


def similar_size(a: str, b: str) -> Column:
    """The length filter."""
    return (NUM * F.col(a) <= DEN * F.col(b)) & (NUM * F.col(b) <= DEN * F.col(a))


def least_shared(n_a: str, n_b: str) -> Column:
    """The least intersection of two linked sets; see ``required``."""
    return F.ceil(NUM * (F.col(n_a) + F.col(n_b)) / F.lit(float(NUM + DEN)) - 1e-9)


def meetings(n_a: str, n_b: str) -> Column:
    """How many shingles two linked sets share within their stored prefixes, at least: what they need less what either holds behind its prefix."""
    behind = lambda n: F.ceil(NUM * F.col(n) / F.lit(float(DEN)) - 1e-9) - 1
    return least_shared(n_a, n_b) - F.greatest(behind(n_a), behind(n_b))


def early(pos_a: str, n_a: str, pos_b: str, n_b: str) -> Column:
    """The positional filter: whether the shared shingle could be the first that two linked sets share.

    Past their first shared shingle both sets have to hold what is left of the required intersection, so a
    linked pair has a shared shingle that passes; pairs meet at such shingles only.
    """
    least = least_shared(n_a, n_b)
    return (F.col(pos_a) <= F.col(n_a) - least) & (F.col(pos_b) <= F.col(n_b) - least)


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """A lower bound of the symmetric difference: split both sorted sets at a middle element, again and again."""
    if depth == 0 or len(a) == 0 or len(b) == 0:
        return abs(len(a) - len(b))
    mid = b[len(b) // 2]
    i, j = int(np.searchsorted(a, mid)), len(b) // 2
    return suffix_bound(a[:i], b[:j], depth - 1) + suffix_bound(a[i:], b[j:], depth - 1)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    most = len(a) + len(b) - 2 * required(len(a), len(b))
    if suffix_bound(a, b) > most:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


@released
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (hub, salt, side): a hub's own text, then the texts to hold against it."""
    hub, own = None, None
    for batch in batches:
        a, b = [], []
        known = [batch.column(c).to_pylist() for c in ("hub", "salt", "side", "other")]
        for h, salt, side, other, text in zip(*known, batch.column("text")):
            if side == 0:
                hub, own = (h, salt), shingle_set(text.as_py())
            elif hub == (h, salt) and linked(own, shingle_set(text.as_py())):
                a.append(other)
                b.append(h)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _marked(ids: DataFrame, key: str) -> DataFrame:
    """A bitmap of 2**25 bits over the ids, 4 MB however many there are; a text whose bit is off isn't wanted."""
    bit = F.pmod(F.xxhash64(key), F.lit(1 << 25))
    return ids.select(bit.alias("__bit")).groupBy(F.bitmap_bucket_number("__bit").alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__map")
    )


def wanted_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text), one row an id (a row's mark), of at least the rows in ``ids``: the bitmap keeps most other texts from
    the shuffle. Callers join by ``id``, not by a semi join, which Spark would move below the bitmap."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << 25))
    marks = stored(_marked(ids, "id"), "bitmap")
    rows = docs.select(row_mark().alias("id"), "text").withColumn("__bucket", F.bitmap_bucket_number(bit))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("__map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = rows.join(F.broadcast(marks), "__bucket").where(F.call_function("getbit", byte, (at % 8).cast("int")) == 1)
    return near.select("id", "text").dropDuplicates(["id"])


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (other, hub) of row marks whose whole sets are linked, as (a, b).

    Each ``other`` text is sent once to each of its hubs; a hub's text goes to every salt of its pairs, of which there is
    one for every ``HUB`` of them. Texts are shuffled twice: to those who ask for them, and from there to the hubs.
    """
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(float(HUB))).cast("long").alias("salts"))
    salt = F.pmod(F.xxhash64("other"), F.col("salts")).cast("int").alias("salt")
    pairs = stored(spread_join(pairs, sizes, "hub").select("other", "hub", salt), "pairs")
    own = pairs.select(F.col("hub").alias("other"), "hub", "salt", F.lit(0).alias("side")).distinct()
    asked = own.unionByName(pairs.withColumn("side", F.lit(1)))
    texts = wanted_texts(docs, pairs.select(F.explode(F.array("other", "hub")).alias("id"))).withColumnRenamed("id", "other")
    rows = asked.join(texts, "other")
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "side")
    return dealt.mapInArrow(_verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), by alternating large and small stars."""
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 31))).first()
        if tuple(now) == state:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        state = tuple(now)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("__m")).select("a", F.least("a", "__m").alias("m"))
        large = stored(_with_least(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = _with_least(large, low).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small")


def _with_least(edges: DataFrame, low: DataFrame) -> DataFrame:
    # the second key lets adaptive execution split a vertex of very many edges; see common.spread_join
    w = F.pmod("a", F.lit(2))
    return edges.withColumn("__w", w).join(low.withColumn("__w", w), ["a", "__w"]).drop("__w")


def _cross_pairs(shared: DataFrame, tried: DataFrame) -> DataFrame:
    """(other, hub) of different components that meet at a shingle early enough and share as many as linked sets must, each
    pair once and none of those ``tried`` before.

    Of a linked pair the smaller set (by size, then id) holds the first shared shingle within its first
    seventh, so only such rows look for partners. Shingles of a single component take no part, and all
    conditions belong to the join, so pairs that fail them are never rows. What is left is counted by the sets' shared prefixes.
    """
    mixed = shared.groupBy("token").agg(F.min("component").alias("l"), F.max("component").alias("h")).where("l != h").select("token")
    live = stored(shared.join(mixed, "token", "left_semi"), "live")
    side = lambda s: live.select(F.col("token"), *[F.col(c).alias(f"{c}_{s}") for c in ("component", "id", "n", "pos")])
    small = side("a").where((NUM + DEN) * F.col("pos_a") <= (DEN - NUM) * F.col("n_a"))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") < F.col("id_b")))
    meet = (F.col("component_a") != F.col("component_b")) & ordered & similar_size("n_a", "n_b") & early("pos_a", "n_a", "pos_b", "n_b")
    met = small.withColumnRenamed("token", "token_a").join(side("b"), (F.col("token_a") == F.col("token")) & meet)
    pairs = met.select(F.col("id_a").alias("other"), F.col("id_b").alias("hub"), "n_a", "n_b").distinct()
    either = tried.select("other", "hub").unionByName(tried.select(F.col("hub").alias("other"), F.col("other").alias("hub")))
    pairs = stored(pairs.join(either, ["other", "hub"], "left_anti"), "met")
    # a list is no longer than one set's prefix
    lists = stored(live.groupBy("id").agg(F.collect_list("token").alias("tokens")), "lists")
    for end in ("other", "hub"):
        pairs = spread_join(pairs, lists.select(F.col("id").alias(end), F.col("tokens").alias(f"{end}_tokens")), end)
    # shingles of one set that fall together as tokens are counted as shared
    alike = F.size("other_tokens") - F.size(F.array_distinct("other_tokens"))
    both = F.size(F.array_intersect("other_tokens", "hub_tokens")) + alike
    return stored(pairs.where(both >= meetings("n_a", "n_b")).select("other", "hub").distinct(), "candidates")


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n, name, kept): one row per input row. ``name`` is the smallest doc_id of the row's component, NOBODY
    where all are null; ``kept`` the mark of the row that stands for it: smallest doc_id, then mark. Both are null without words.

    Classes are known by the mark of one of their rows, so rows that share a doc_id, or have none, are told apart by their texts.
    """
    rows, counts = digests(docs)
    top = F.min(F.struct(F.coalesce("doc_id", F.lit(NOBODY)).alias("low"), "mark")).alias("top")
    classes = stored(rows.where("n > 0").groupBy("cls", "key").agg(top, F.first("n").alias("n")).withColumn("id", F.col("top.mark")), "classes")
    named = shared_prefixes(docs, counts)
    by_key = classes.select("key", "id", "n")
    shared = stored(
        named.join(by_key, "key").join(by_key.toDF("pivot", "pivot_id", "pivot_n"), "pivot").drop("key", "pivot").distinct(),
        "shared",
    )
    # pairs that meet too seldom are left to the second round, which counts the shingles at which they meet without a pivot too
    first = stored(
        shared.where((F.col("id") != F.col("pivot_id")) & similar_size("n", "pivot_n"))
        .groupBy("id", "pivot_id", "n", "pivot_n")
        .agg(F.count("*").alias("c"))
        .where(F.col("c") >= meetings("n", "pivot_n"))
        .groupBy("id")
        .agg(F.max(F.struct("c", "pivot_id")).alias("best"))
        .select(F.col("id").alias("other"), F.col("best.pivot_id").alias("hub")),
        "first",
    )
    links = stored(verified(docs, first), "links")
    parts = stored(components(links), "components")
    labelled = shared.join(parts, "id", "left").select("token", "pos", "id", "n", F.coalesce("component", "id").alias("component"))
    more = stored(verified(docs, _cross_pairs(stored(labelled.distinct(), "labelled"), first)), "links")
    parts = stored(components(links.unionByName(more)), "components")
    # documents have their say only now: the smallest doc_id of all classes names the component
    grouped = stored(classes.join(parts, "id", "left").select("cls", "top", F.coalesce("component", "id").alias("component")), "grouped")
    names = grouped.groupBy("component").agg(F.min("top").alias("best"))
    by_class = stored(spread_join(grouped, names, "component").select("cls", F.col("best.low").alias("name"), F.col("best.mark").alias("kept")), "names")
    return rows.join(by_class, "cls", "left").select("doc_id", "mark", "n", "name", "kept")


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per input row."""
    name = F.coalesce("name", "doc_id")
    return _labelled(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(name != NOBODY, name).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id (null counts as the largest); rows without words stay.

    Of rows alike in doc_id and text one stays.
    """
    rows = _labelled(docs)
    asked = rows.where("n > 0 and mark = kept").groupBy("mark").agg(F.count("*").alias("__m"))
    asked = stored(asked.unionByName(rows.where("n = 0").groupBy("mark").agg(F.lit(1).cast("long").alias("__m"))), "kept")
    marked = docs.select(F.struct("*").alias("__doc"), row_mark().alias("mark")).join(asked, "mark")
    once = marked.where("__m = 1")
    # texts are shuffled to be made single only where some rows are alike
    again = marked.where("__m > 1").dropDuplicates(["mark"])
    return once.unionByName(again).select("__doc.*")


QUERY = "op7_ngram_jaccard_join"
SQL = None


def query(spark, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
