"""Prefix trie, Merkle manifest and byte-level BPE against brute force, on small fixtures."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaykit.llm import bytepairs, merkle, places, prefix_trie
from tests.llm.test_corpus import DOCS, LONG, TEXTS, documents, empty

TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def all_rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# -- places -------------------------------------------------------------------


def test_places_and_running_sums_over_many_ranges(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 700)).alias("g"), (F.col("id") * 37 % 3001).alias("v")
    )
    got = places.placed(rows.repartition(5), "g", [F.desc("v")], "test-places").collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r.pos, r.v, r.n))
    for group in by.values():
        group.sort()
        assert [p for p, _, _ in group] == list(range(len(group))) and {n for *_, n in group} == {len(group)}
        assert [v for _, v, _ in group] == sorted((v for _, v, _ in group), reverse=True)
    sums = places.running(spark.createDataFrame(got), "g", F.floor(F.col("pos") / 7), F.col("pos"), ["v"]).collect()
    for r in sums:
        assert r.v == sum(v for p, v, _ in by[r.g] if p <= r.pos)


# -- 11 prefix trie -----------------------------------------------------------


def slow_trie(rows):
    digest = lambda role, text: hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    given = {}
    for c, turn, role, text in rows:
        given.setdefault(c, []).append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    given = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in given.items()}
    built = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9 if c is not None else 0
        base = c - int(np.fmod(c, 5)) if c is not None else None
        built[c] = (given.get(base, [])[:h] if c is not None else []) + own[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    low = {k: min((c for c in v if c is not None), default=None) for k, v in members.items()}
    kids = {k: [x for x in members if len(x) == len(k) + 1 and x[: len(k)] == k] for k in members}
    out = []
    for k, v in members.items():
        under = [x for x in members if x[: len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x)
        ended = ",".join(str(c) for c in sorted(c for c in v if c is not None and len(built[c]) == len(k)))
        out.append((low[k], len(k), low[k[:-1]] if k else None, len(v), len(kids[k]), sum(not kids[x] for x in under), saved, sha(ended)))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(spark, rows):
    return spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("c", F.lit(1)).repartition(3)


def odd_conversations():
    r = random.Random(7)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["a", "b", "ä 中", ""])) for c in range(60) for t in range(r.choice([1, 2, 5, 12]))]
    rows += [(None, 1, "user", "no number"), (None, None, None, None), (77, None, "user", None), (77, 3, None, "x"), (77, 3, None, "x"), (77, 3, "user", "x")]
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 140) for t in range(20)]  # copies
    rows += [(200, t, "user", f"turn {t}") for t in range(150)]  # one very long
    rows += [(-3, 1, "user", "below zero"), (5 * 10**12, 1, "user", "a")]
    return rows


@pytest.mark.parametrize("limit,stretch", [(4096, 64), (3, 4), (1, 1)])
def test_trie(spark, limit, stretch):
    rows = odd_conversations()
    got = prefix_trie.prefix_trie(conversations(spark, rows), limit, stretch)
    assert all_rows(got, COLUMNS) == slow_trie(rows)


def test_trie_of_one_and_none(spark):
    got = prefix_trie.prefix_trie(conversations(spark, [(3, 0, "user", "héllo")]))
    assert all_rows(got, COLUMNS) == slow_trie([(3, 0, "user", "héllo")])
    assert prefix_trie.prefix_trie(empty(spark, TURNS)).count() == 0
    only = prefix_trie.prefix_trie(conversations(spark, [(None, 0, "user", "a")])).collect()
    assert len(only) == 2 and {r.conv_id for r in only} == {None}


def test_bursts_split_full_containers_and_leave_small_ones(spark):
    steps = prefix_trie.fingerprinted(prefix_trie.rebuilt(prefix_trie.turns_in_order(conversations(spark, odd_conversations())))[1])
    nodes, small = prefix_trie.burst(prefix_trie.suffixes(steps), 3)
    assert len(nodes) > 1
    for part in small:
        sizes = [r["count"] for r in part.groupBy("depth", "h1", "h2").count().collect()]
        assert all(n <= 3 for n in sizes)


def test_fingerprints_add_up_alike_in_both_forms():
    for a, b in [(0, 0), (-1, 2**63 - 1), (2**62, -(2**40)), (12345678901, -98765432101)]:
        wrap = lambda x: x - 2**64 if x >= 2**63 else x
        lanes = [(((a >> s) & prefix_trie._MASK) + ((b >> s) & prefix_trie._MASK)) & prefix_trie._MASK for s in (32, 0)]
        assert prefix_trie._plus(a, b) == wrap(lanes[0] << 32 | lanes[1])


# -- 12 Merkle manifest -------------------------------------------------------


def slow_manifest(rows, fan):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(one, r)))
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def build(hashes):
        """Root and, for each leaf, its siblings as (left, right) level by level."""
        paths, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            runs = [hashes[i : i + fan] for i in range(0, len(hashes), fan)]
            for i, p in enumerate(at):
                run, slot = runs[p // fan], p % fan
                paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
                at[i] = p // fan
            hashes = [sha("".join(r)) for r in runs]
        return hashes[0], paths

    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        r = (doc_id, source, lang, n_chars, text)
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(r), doc_id, leaf((*r[:4], lower(text))) if changed else leaf(r)))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {k: build([r[2] for r in sorted(trees[k], key=lambda r: r[:3])]) for k in names}
    root, upper = build([built[k][0] for k in names])
    out = []
    for k, up in zip(names, upper):
        for (_, _, own, doc_id, changed), path in zip(sorted(trees[k], key=lambda r: r[:3]), built[k][1]):
            h = changed
            for left, right in [*path, *up]:
                h = sha(left + h + right)
            out.append((doc_id, own, built[k][0], root, sha("".join(a + b for a, b in [*path, *up])), h, h == root))
    return sorted(out, key=repr)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def many_documents():
    rows = [(i, t, "en" if i % 2 else None, [None, "b", "a"][i % 3], len(t) if t else None) for i, t in enumerate(TEXTS)]
    rows += [(1000 + i, f"Text {i}", "de", "s", i) for i in range(150)]
    rows += [(7, "Again", "de", None, None), (7, "Again", "de", None, None), (7, "And again", "de", None, None), (None, None, "de", None, None), (None, "X", "de", None, None)]
    rows += [(3000 + i, "ALONE", lang, None, None) for i, lang in enumerate(["", "Zz", "ä", "中", "a b", "-", "=", "0", "1", "2"])]
    return rows


@pytest.mark.parametrize("fan,levels", [(8, 3), (2, 2), (3, 1)])
def test_manifest(spark, fan, levels):
    rows = many_documents()
    docs = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit("x")).withColumn("row", F.lit(1)).withColumn("pos", F.lit(2)).repartition(3)
    got = all_rows(merkle.checked(docs, fan, levels), MANIFEST)
    assert got == slow_manifest(rows, fan)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_and_none(spark):
    one = [(5, "A", None, None, 1)]
    assert all_rows(merkle.checked(spark.createDataFrame(one, DOCS)), MANIFEST) == slow_manifest(one, 8)
    assert merkle.checked(empty(spark)).count() == 0


def test_manifest_is_the_same_however_rows_lie(spark):
    docs = spark.createDataFrame(many_documents(), DOCS)
    assert all_rows(merkle.checked(docs.repartition(7)), MANIFEST) == all_rows(merkle.checked(docs.coalesce(1)), MANIFEST)


# -- 13 byte-level BPE --------------------------------------------------------

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def own():
    return bytepairs.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def other():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def same(own, other, text):
    ids = own.packed(text)
    assert np.frombuffer(ids, "<u4").tolist() == other.encode_ordinary(text)
    assert own.bytes_of(ids) == text.encode()


def test_every_token_of_several_bytes_has_a_last_merge(own):
    assert sum(h is None for h in own.merges.halves) == 256
    for token, halves in zip(own.merges.token, own.merges.halves):
        assert halves is None or b"".join(own.merges.token[h] for h in halves) == token


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text_as_the_library(own, other, text):
    same(own, other, text)


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet="aàenrst ing-_=/1.9'\n\t中😀", max_size=200))
def test_dense_text_as_the_library(own, other, text):
    same(own, other, text)


def test_joined_tokens_and_long_cuts_as_the_library(own, other):
    r = random.Random(3)
    for _ in range(3000):
        same(own, other, b"".join(own.merges.token[r.randrange(len(own.merges.token))] for _ in range(r.choice([2, 3, 6]))).decode("latin-1"))
    for text in ["a" * 20_000, " " * 20_001, "ab" * 9_000, "-_" * 9_000, "é" * 9_000, "x" + "=" * 9_999 + "y", "".join(r.choice("abcdehilnorst") for _ in range(20_000))]:
        same(own, other, text)


def test_memory_of_cuts_and_pairs_is_bounded(own, other, monkeypatch):
    monkeypatch.setattr(bytepairs, "REMEMBERED", 10)
    fresh = bytepairs.Codec(PATH, PATTERN)
    same(fresh, other, LONG[:20_000])
    assert len(fresh.cuts) <= 10 and len(fresh.merges.known) <= 10


def test_cuts_that_come_again_outlive_the_others(own, monkeypatch):
    monkeypatch.setattr(bytepairs, "REMEMBERED", 50)
    cuts, encoded = bytepairs.Cuts(own.merges), []
    monkeypatch.setattr(own.merges, "encode", lambda cut: encoded.append(cut) or [0])
    for i in range(1000):
        cuts[" again"], cuts[f" once{i}"]
    assert encoded.count(b" again") == 1 and len(encoded) == 1001
    assert len(cuts) <= 50 and len(cuts.old) <= 50


def test_round_trip(spark, own, other):
    texts = [*TEXTS, "<|endoftext|> is text", "a" * 50_000]
    got = {r.doc_id: r for r in bytepairs.round_trip(documents(spark, texts, extra=True), PATH, PATTERN).collect()}
    assert len(got) == len(texts) + 1
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = other.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bytepairs.round_trip(empty(spark), PATH, PATTERN).count() == 0


def test_encode_and_decode_carry_columns(spark):
    docs = documents(spark)
    back = bytepairs.decode(bytepairs.encode(docs, PATH, PATTERN, carry=("doc_id", "lang")), PATH, PATTERN, carry=("doc_id", "lang"))
    assert all_rows(back.withColumn("text", F.col("bytes").cast("string")), ["doc_id", "lang", "text"]) == all_rows(docs.na.fill("", ["text"]), ["doc_id", "lang", "text"])
