"""Burst trie over the turns of conversations.

Conversations that begin with the same turns share nodes. Their turns are hashed to ids; a conversation is cut into
stretches of STRETCH turns, and each stretch is a suffix in the container of a trie head: the node where it starts. Heads
are known by the fingerprint of the turns above them, a running sum of hashes of (depth, turn id), so all stretches
find their container at once, however long a conversation is. Equal suffixes of a container are one, with their count.

A container of more than LIMIT suffixes is burst by next turn id: each next turn becomes a node and a head, whose
container holds what follows. Bursts end when every container is small, after at most STRETCH rounds. The shards of the
remaining containers are sorted and swept: a stack of open nodes follows the sorted suffixes, and a node is put out when
no further suffix passes it.

Sums over subtrees need no walk over levels: every node belongs to its smallest member, so a conversation carries the sum of its
own nodes at or below each depth, and a node's subtree is the sum over all conversations that pass it.

Defined cases: null role or text is empty; turns are ordered by turn (null first), equal ones by role, then by digest; repeated rows
are turns of their own; a null conv_id is one conversation without a shared beginning, ordered last, and left out of the list of ends (id
2 ** 63 - 1 counts as null); an empty table has no nodes. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import crc32_sql, stored, table
from assaykit.llm.places import placed, running

LIMIT = 4096
STRETCH = 64
MOST_SHARED = 8
ID = 32  # characters of a turn id
NOBODY = 2**63 - 1
NODE = ["depth", "p1", "p2"]
HEAD = ["depth", "h1", "h2"]
_LANES = ["x1", "x2", "x3", "x4"]
_MASK = 2**32 - 1


def turn_id(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def lanes(depth: Column, turn: Column) -> list[Column]:
    """Four numbers below 2**32 for a turn at a depth; their sums along a path are its fingerprint."""
    h = F.md5(F.concat(depth.cast("string"), F.lit(":"), turn))
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.bitwiseAND(F.lit(_MASK)), 32).bitwiseOR(b.bitwiseAND(F.lit(_MASK)))


def packed(x: list[Column]) -> tuple[Column, Column]:
    """Sums of four lanes, each modulo 2**32, as two longs."""
    return _pair(x[0], x[1]), _pair(x[2], x[3])


def unpacked(p1: Column, p2: Column) -> list[Column]:
    return [c for p in (p1, p2) for c in (F.shiftrightunsigned(p, 32), p.bitwiseAND(F.lit(_MASK)))]


def _lanes_of(depth: int, turn: str) -> tuple[int, int]:
    """As ``lanes``, packed; for the sweep."""
    h = hashlib.md5(f"{depth}:{turn}".encode()).hexdigest()
    return int(h[:16], 16), int(h[16:], 16)


def _plus(a: int, b: int) -> int:
    """Sum of two packed pairs, lane by lane, as a signed long."""
    high, low = ((a >> 32) + (b >> 32)) & _MASK, ((a & _MASK) + (b & _MASK)) & _MASK
    made = high << 32 | low
    return made - 2**64 if made >= 2**63 else made


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(c, pos, n, tid, bytes): ``pos`` from 0 in each of the conversations, of ``n`` turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NOBODY)).alias("c"),
        "turn",
        role.alias("role"),
        turn_id(role, text).alias("tid"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("tid"), F.col("row")]
    return stored(placed(stored(rows, "turns"), "c", order, "turns-in-order").select("c", "pos", "n", "tid", "bytes"), "turns-placed")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations (c), and the turns (c, d, tid, bytes) of each after taking over the beginning of another.

    A conversation c begins with the first h turns of conversation c - c % 5; h is its CRC-32 modulo 9.
    """
    convs = turns.where("pos = 0").select("c", "n")
    shared = F.when(F.col("c") != NOBODY, F.crc32(F.col("c").cast("string")) % (MOST_SHARED + 1)).otherwise(0)
    convs = convs.withColumn("h", shared).withColumn("base", F.when(F.col("c") != NOBODY, F.col("c") - F.col("c") % 5))
    lengths = convs.select(F.col("c").alias("base"), F.col("n").alias("held"))
    convs = stored(convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("held", F.lit(0)))).select("c", "h", "base", "taken"), "conversations")
    heads = turns.where(F.col("pos") < MOST_SHARED).select(F.col("c").alias("base"), "pos", "tid", "bytes")
    first = convs.join(heads, "base").where("pos < taken").select("c", (F.col("pos") + 1).alias("d"), "tid", "bytes")
    own = turns.join(convs, "c").where("pos >= h").select("c", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("d"), "tid", "bytes")
    return convs.select("c"), first.unionByName(own)


def fingerprinted(sequences: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``sequences`` with (p1, p2), the fingerprint of the turns up to this one, and (q1, q2), that of those before it."""
    marks = sequences.withColumns(dict(zip(_LANES, lanes(F.col("d"), F.col("tid")))))
    marks = marks.withColumns({f"own_{x}": F.col(x) for x in _LANES})
    summed = running(marks, "c", F.floor((F.col("d") - 1) / stretch), F.col("d"), _LANES)
    here = packed([F.col(x) for x in _LANES])
    before = packed([F.col(x) - F.col(f"own_{x}") for x in _LANES])
    return summed.select("c", "d", "tid", "bytes", here[0].alias("p1"), here[1].alias("p2"), before[0].alias("q1"), before[1].alias("q2"))


def suffixes(steps: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The containers of the trie's first heads: (depth, h1, h2, suffix, sizes, w, low), one row per distinct suffix.

    ``suffix`` is the turn ids joined, ``w`` the number of conversations with it, ``low`` the smallest of them.
    """
    cut = steps.withColumn("s", F.floor((F.col("d") - 1) / stretch))
    part = cut.groupBy("c", "s").agg(
        F.sort_array(F.collect_list(F.struct("d", "tid", "bytes"))).alias("t"), F.min(F.struct("d", "q1", "q2")).alias("first")
    )
    rows = part.select(
        (F.col("s") * stretch).alias("depth"),
        F.col("first.q1").alias("h1"),
        F.col("first.q2").alias("h2"),
        F.array_join("t.tid", "").alias("suffix"),
        F.col("t.bytes").alias("sizes"),
        "c",
    )
    return rows.groupBy(*HEAD, "suffix").agg(F.first("sizes").alias("sizes"), F.count("*").alias("w"), F.min("c").alias("low"))


def burst(containers: DataFrame, limit: int = LIMIT) -> tuple[list[DataFrame], list[DataFrame]]:
    """Burst containers until none has more than ``limit`` suffixes: the nodes made on the way, and what remains."""
    nodes, small = [], []
    while True:
        full = stored(containers.groupBy(*HEAD).count().where(F.col("count") > limit).select(*HEAD), "oversized")
        if full.isEmpty():
            return nodes, [*small, containers]
        small.append(containers.join(full, HEAD, "left_anti"))
        turn, depth = F.substring("suffix", 1, ID), F.col("depth") + 1
        p1, p2 = packed([a + b for a, b in zip(unpacked(F.col("h1"), F.col("h2")), lanes(depth, turn))])
        moved = containers.join(full, HEAD).select(
            depth.alias("depth"), p1.alias("p1"), p2.alias("p2"), F.col("h1").alias("q1"), F.col("h2").alias("q2"),
            F.col("sizes")[0].alias("bytes"), F.expr(f"substring(suffix, {ID + 1})").alias("suffix"), F.expr("slice(sizes, 2, size(sizes))").alias("sizes"), "w", "low",
        )
        moved = stored(moved, "burst")
        nodes.append(
            moved.groupBy(*NODE, "q1", "q2").agg(F.first("bytes").alias("bytes"), F.sum("w").alias("n"), F.min("low").alias("low"))
        )
        containers = moved.where("suffix <> ''").select("depth", F.col("p1").alias("h1"), F.col("p2").alias("h2"), "suffix", "sizes", "w", "low")


_NODES = "depth long, p1 long, p2 long, q1 long, q2 long, bytes long, n long, low long"
_COLUMNS = [x.split()[0] for x in _NODES.split(", ")]


def _swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suffixes come sorted inside their containers; open nodes wait on a stack, at most a stretch of them."""
    head, last, stack = None, "", []

    def close(depth: int) -> Iterator[tuple]:
        while len(stack) > depth:
            node = stack.pop()
            if stack:
                stack[-1][6] += node[6]
                stack[-1][7] = min(stack[-1][7], node[7])
            yield tuple(node)

    for pdf in batches:
        out: list[tuple] = []
        for depth, h1, h2, suffix, sizes, w, low in pdf.itertuples(index=False, name=None):
            if (depth, h1, h2) != head:
                out.extend(close(0))
                head, last = (depth, h1, h2), ""
            same = next((i for i, (a, b) in enumerate(zip(suffix, last)) if a != b), min(len(suffix), len(last))) // ID
            out.extend(close(same))
            for i in range(same, len(suffix) // ID):
                q1, q2 = stack[-1][1:3] if stack else (h1, h2)
                a, b = _lanes_of(depth + i + 1, suffix[i * ID : (i + 1) * ID])
                stack.append([depth + i + 1, _plus(q1, a), _plus(q2, b), q1, q2, sizes[i], 0, NOBODY])
            stack[-1][6] += w
            stack[-1][7] = min(stack[-1][7], low)
            last = suffix
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)
    if stack:
        yield pd.DataFrame(list(close(0)), columns=_COLUMNS)


def sweep(containers: DataFrame) -> DataFrame:
    """The nodes below the heads of ``containers``."""
    shards = containers.select(*HEAD, "suffix", "sizes", "w", "low").repartition(*HEAD).sortWithinPartitions(*HEAD, "suffix")
    return shards.mapInPandas(_swept, _NODES)


def trie(steps: DataFrame, limit: int = LIMIT, stretch: int = STRETCH) -> DataFrame:
    """(depth, p1, p2, q1, q2, bytes, n, low, n_children): every node but the root.

    A node is known by its depth and fingerprint, its parent by (q1, q2); ``n`` conversations pass it, ``low`` is the smallest.
    """
    nodes, small = burst(stored(suffixes(steps, stretch), "suffixes"), limit)
    for part in small[1:]:
        small[0] = small[0].unionByName(part)
    every = sweep(small[0])
    for part in nodes:
        every = every.unionByName(part.select(*_COLUMNS))
    every = stored(every, "nodes")
    kids = every.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    return stored(every.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ids come sorted inside their nodes; a node of any size is one running hash."""
    at, hashed, any_yet = None, None, False
    for pdf in batches:
        out = []
        for key, rows in itertools.groupby(zip(*(pdf[c] for c in [*NODE, "c"])), lambda r: r[:3]):
            if key != at:
                if at is not None:
                    out.append((*at, hashed.hexdigest()))
                at, hashed, any_yet = key, hashlib.sha256(), False
            listed = ",".join(str(r[3]) for r in rows if r[3] != NOBODY)
            if listed:
                hashed.update(("," if any_yet else "").encode() + listed.encode())
                any_yet = True
        if out:
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, hashed.hexdigest())], columns=[*NODE, "ends_sha256"])


def ends(convs: DataFrame, steps: DataFrame) -> DataFrame:
    """Per node at which conversations end: the digest of their ids, ascending, joined by commas."""
    last = steps.groupBy("c").agg(F.max(F.struct("d", "p1", "p2")).alias("last"))
    at = convs.join(last, "c", "left").select(*[F.coalesce(f"last.{a}", F.lit(0).cast("long")).alias(b) for a, b in zip(("d", "p1", "p2"), NODE)], "c")
    return at.repartition(*NODE).sortWithinPartitions(*NODE, "c").mapInPandas(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def below(nodes: DataFrame, steps: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Per node: the childless nodes (``n_leaves``) and repeated bytes (``saved``) of its subtree."""
    own = nodes.select(F.col("low").alias("c"), F.col("depth").alias("d"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    rows = steps.select("c", "d", "p1", "p2").join(own, ["c", "d"], "left").na.fill(0, ["n_leaves", "saved"])
    up = running(rows, "c", -F.floor((F.col("d") - 1) / stretch), -F.col("d"), ["n_leaves", "saved"])
    carried = up.where("n_leaves > 0 or saved > 0")
    return carried.groupBy(F.col("d").alias("depth"), "p1", "p2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, stretch: int = STRETCH) -> DataFrame:
    """One row per node of the trie over rebuilt conversations, the root included."""
    convs, sequences = rebuilt(turns_in_order(conversations))
    steps = stored(fingerprinted(sequences, stretch), "steps")
    nodes = trie(steps, limit, stretch)
    name = lambda c: F.when(F.col(c) != NOBODY, F.col(c))
    zero = F.lit(0).cast("long")

    own = convs.select("c", F.lit(1).alias("one"), zero.alias("kid"), zero.alias("leaf"), zero.alias("saved"))
    made = nodes.select(
        F.lit(NOBODY).alias("c"), F.lit(0).alias("one"), (F.col("depth") == 1).cast("long").alias("kid"), (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n") - 1) * F.col("bytes")).alias("saved"),
    )
    root = own.unionByName(made).agg(
        F.min("c").alias("low"), F.sum("one").alias("n"), F.sum("kid").alias("n_children"), F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.sum("saved").alias("saved")
    )
    root = root.where("n > 0").select(*[zero.alias(c) for c in NODE], "low", F.lit(None).cast("long").alias("up"), "n", "n_children", "n_leaves", "saved")
    root = stored(root, "root")

    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("low").alias("up"))
    top = root.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("low").alias("up"))
    linked = nodes.join(parents.unionByName(top), ["depth", "q1", "q2"])
    every = linked.join(below(nodes, steps, stretch), NODE).select(*root.columns).unionByName(root)
    listed = every.join(ends(convs, steps), NODE, "left")
    return listed.select(
        name("low").alias("conv_id"),
        "depth",
        name("up").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


QUERY = "op11_prefix_trie"
SQL = f"""
WITH given AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
ids AS (SELECT c, turn, role, md5(octet_length(encode(role)) || ':' || role || text) AS tid, octet_length(encode(text)) AS bytes FROM given),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, tid) - 1 AS pos FROM ids),
convs AS (SELECT c, coalesce({crc32_sql("c")} % 9, 0) AS h, c - c % 5 AS base FROM (SELECT DISTINCT c FROM given)),
rows AS (
  SELECT v.c, p.pos AS o, p.tid, p.bytes FROM convs v JOIN placed p ON p.c = v.base AND p.pos < v.h
  UNION ALL
  SELECT v.c, 100 + p.pos, p.tid, p.bytes FROM convs v JOIN placed p ON p.c IS NOT DISTINCT FROM v.c AND p.pos >= v.h),
seqs AS (
  SELECT v.c, coalesce(list(r.tid ORDER BY r.o) FILTER (r.tid IS NOT NULL), []) AS t, coalesce(list(r.bytes ORDER BY r.o) FILTER (r.tid IS NOT NULL), []) AS b
  FROM convs v LEFT JOIN rows r ON r.c IS NOT DISTINCT FROM v.c GROUP BY v.c),
passed AS (SELECT c, t, b, unnest(range(0, len(t) + 1)) AS d FROM seqs),
nodes AS (
  SELECT d, array_to_string(t[1:d], ' ') AS k, array_to_string(t[1:greatest(d - 1, 0)], ' ') AS up, min(c) AS c, count(*) AS n, coalesce(any_value(CASE WHEN d > 0 THEN b[d] END), 0) AS bytes,
         any_value(t[1:d]) AS t, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(t) = d), '') AS ends
  FROM passed GROUP BY d, array_to_string(t[1:d], ' '), array_to_string(t[1:greatest(d - 1, 0)], ' ')),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY up, d),
flat AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.k = n.k AND kids.d = n.d),
above AS (SELECT array_to_string(t[1:j], ' ') AS k, j AS d, n_children, n, bytes FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM flat)),
sums AS (SELECT k, d, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * bytes) AS saved FROM above GROUP BY k, d)
SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n AS n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM flat f JOIN sums s ON s.k = f.k AND s.d = f.d LEFT JOIN flat p ON f.d > 0 AND p.d = f.d - 1 AND p.k = f.up
"""


def query(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
