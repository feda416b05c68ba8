"""Exact top-k where neither side fits a broadcast: one side in chunks, the other streamed where it lies.

Both sides are stored once in blocks of similar vectors, each with a centroid and a radius. A round broadcasts one
chunk of the smaller side (a bounded number of bytes, the most that the driver ever holds) and streams the stored
blocks of the larger side past it; no vector is copied per round or shuffled again.

Every query starts with a bound: the similarity of its k-th nearest among the pool's seeds, a few hundred of the
pool's own rows. No pool row below that can be in the answer, so a block of the pool whose centroid and radius promise less
is skipped: q.p <= q.c + |q| r for each p within r of c. Bounds rise as rounds are done: in the tasks that hold the queries
by the running k-th row, across rounds by the least k-th row of each block of queries. Blocks of the larger side that a chunk cannot
better are cut off by a range filter that reaches the files, and a chunk that can better none is no round at all.

Pruning never changes the answer: what is skipped lies below the k-th row by more than the rounding of similarities.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.ordering import smallest_by_hash
from assaykit.operators.topk import BLOCK_ROWS, Running, best, ids_of, matrix
from assaykit.session import shared_folder, written

SEEDS = 512
ROUNDS = 12  # more rounds than these take several chunks each, as far as a broadcast may hold them
_SLACK = 1e-6  # more than sums of rounded products can be off


@dataclass
class Side:
    """One side, stored in blocks: ``table`` (key, vector[, by], __block, __far, __kth); arrays hold a place for each block."""

    table: DataFrame
    key: str
    seeds: tuple[np.ndarray, np.ndarray]  # ids and vectors of the rows that blocks are gathered around
    centre: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    bound: np.ndarray  # least k-th similarity of the block's rows, for queries

    @property
    def norm(self) -> np.ndarray:
        return np.linalg.norm(self.centre, axis=1)


def _reach(centre: np.ndarray, radius: np.ndarray, other: "Side", at: slice) -> np.ndarray:
    """The most that any product of a row of each block with a row of each block in ``other[at]`` can be."""
    c, r = other.centre[at], other.radius[at]
    far = np.linalg.norm(centre, axis=1)[:, None] * r[None, :] + radius[:, None] * np.linalg.norm(c, axis=1)[None, :]
    return centre @ c.T + far + radius[:, None] * r[None, :]


def in_blocks(
    df: DataFrame, key: str, vector: str, dim: int, n: int, block_rows: int, by: str | None = None,
    bounded_by: tuple[np.ndarray, np.ndarray] | None = None, k: int = 1, exclude_self: bool = False,
) -> Side:
    """Store ``df`` in blocks of about ``block_rows`` similar rows, shuffling its vectors once.

    ``bounded_by`` holds ids and vectors of some pool rows; each row then carries the similarity of its k-th nearest among them.
    """
    n_seeds = max(1, min(SEEDS, n // max(1, block_rows) + 1))
    picked = smallest_by_hash(df.select(key, vector), n_seeds, [key], "seed").toArrow().combine_chunks()
    seeds = ids_of(picked.column(0)), matrix(picked.column(1), dim)
    half = (seeds[1] ** 2).sum(axis=1) / 2
    kept = [key, vector, *([by] if by else [])]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("__cell", T.IntegerType()), T.StructField("__far", T.DoubleType()), T.StructField("__kth", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(bounded_by[0], kind="stable") if bounded_by else None
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column(1), dim)
            cell = np.argmax(v @ seeds[1].T - half, axis=1)
            far = np.linalg.norm(v - seeds[1][cell], axis=1)
            kth = np.full(len(v), -np.inf)
            if bounded_by and len(order) >= k:
                own = ids_of(b.column(0)) if exclude_self else None
                kth = best(v, bounded_by[1][order], bounded_by[0][order], k, own)[0][:, -1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype("int32")), pa.array(far), pa.array(kth)], [*kept, "__cell", "__far", "__kth"])

    placed = df.select(*kept).mapInArrow(assign, schema)
    counts = np.zeros(n_seeds, dtype=np.int64)
    for cell, count in placed.groupBy("__cell").count().collect():  # at most SEEDS rows
        counts[cell] = count
    parts = np.maximum(1, -(-counts // block_rows))
    first = np.concatenate([[0], np.cumsum(parts)])
    start, many = (F.element_at(F.lit([int(x) for x in values]), F.col("__cell") + 1) for values in (first[:-1], parts))
    block = (start + F.pmod(F.xxhash64(key), many)).cast("int")
    dealt = placed.withColumn("__block", block).drop("__cell").repartitionByRange("__block").sortWithinPartitions("__block")
    table = written(dealt, "blocks")

    side = Side(table, key, seeds, np.repeat(seeds[1], parts, axis=0), np.zeros(first[-1]), np.zeros(first[-1], np.int64), np.full(first[-1], -np.inf))
    # one row a block: thousands of vectors stand behind each
    for r in table.groupBy("__block").agg(F.max("__far").alias("far"), F.count("*").alias("n"), F.min("__kth").alias("kth")).collect():
        side.radius[r["__block"]], side.rows[r["__block"]], side.bound[r["__block"]] = r["far"], r["n"], r["kth"]
    return side


def _chunks(side: Side, row_bytes: int, chunk_bytes: int) -> Iterator[slice]:
    """Runs of blocks that are about ``chunk_bytes`` together, one block at least."""
    begun, held = 0, 0
    for b, n in enumerate(side.rows):
        if held and held + n * row_bytes > chunk_bytes:
            yield slice(begun, b)
            begun, held = b, 0
        held += int(n) * row_bytes
    yield slice(begun, len(side.rows))


def _by_block(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch cut where its block changes; blocks lie together."""
    block = batch.column(at).to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
    for a, b in zip(edges, edges[1:]):
        yield int(block[a]), batch.slice(a, b - a)


def _range(side: Side, live: np.ndarray) -> DataFrame:
    """Rows of the blocks from the first to the last live one; the filter reaches the files."""
    at = np.flatnonzero(live)
    if at[0] == 0 and at[-1] == len(live) - 1:
        return side.table
    return side.table.where(F.col("__block").between(int(at[0]), int(at[-1])))


def in_rounds(
    queries: DataFrame, pool: DataFrame, k: int, query_id: str, pool_id: str, vector: str, by: str | None, exclude_self: bool,
    dim: int, sizes: tuple[int, int], schema: T.StructType, arrow: pa.Schema, block_rows: int, chunk_bytes: int, prune: bool = True,
    on_round: Callable[[int, int, int], None] | None = None, most_bytes: int = 0,
) -> DataFrame:
    """(query_id, pool_id, sim[, by]): rows among which are the k best of each query (and class); at most k rows a query, class and chunk or task.

    Runs at once, a job or two a round. Each round reads the larger side, so chunks that would make more than ``ROUNDS`` of them
    are taken together, up to ``most_bytes``. ``on_round`` is told the round, the blocks read, and the blocks there are. With ``by`` a class
    may have its k-th row anywhere, so nothing is pruned.
    """
    spark = queries.sparkSession
    prune = prune and by is None
    row_bytes = dim * 8 + 64
    p = in_blocks(pool, pool_id, vector, dim, sizes[1], block_rows, by)
    q = in_blocks(queries, query_id, vector, dim, sizes[0], block_rows, None, p.seeds if prune else None, k, exclude_self)
    out = f"{shared_folder(spark)}/nearest-{np.random.default_rng().integers(2**62):x}"
    streamed_queries = sizes[1] <= sizes[0]
    small, large = (p, q) if streamed_queries else (q, p)

    together = max(chunk_bytes, min(most_bytes, -(-int(small.rows.sum()) * row_bytes // ROUNDS)))
    done = 0
    for chunk in _chunks(small, row_bytes, together):
        live = np.ones(len(large.rows), dtype=bool)
        if prune:
            reach = _reach(large.centre, large.radius, small, chunk)
            need = q.bound[:, None] if streamed_queries else q.bound[None, chunk]
            live = (reach >= need - _SLACK).any(axis=1) & (large.rows > 0)
        if not live.any():
            continue
        held = small.table.where(F.col("__block").between(chunk.start, chunk.stop - 1)).toArrow()
        if not len(held):
            continue
        scan = _past_pool if streamed_queries else _past_queries
        run = scan(spark, held, small, large, chunk, live, k, dim, by, exclude_self, prune, arrow)
        found = _range(large, live).mapInArrow(run, T.StructType([*schema.fields, T.StructField("__block", T.IntegerType())]))
        found.write.mode("append").parquet(f"{out}/round={done}")
        if prune and streamed_queries:
            _raise_bounds(spark.read.parquet(f"{out}/round={done}"), q, query_id, k)
        if on_round:
            on_round(done, int(live.sum()), len(live))
        done += 1
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("round", T.IntegerType())])).parquet(out).drop("round")


def _raise_bounds(found: DataFrame, q: Side, query_id: str, k: int) -> None:
    """A block whose every query has k rows in a round is bounded by the least of their k-th rows."""
    each = found.groupBy("__block", query_id).agg(F.count("*").alias("n"), F.min("sim").alias("kth")).where(F.col("n") >= k)
    for r in each.groupBy("__block").agg(F.count("*").alias("n"), F.min("kth").alias("kth")).collect():
        if r["n"] == q.rows[r["__block"]]:
            q.bound[r["__block"]] = max(q.bound[r["__block"]], r["kth"])


def _past_pool(spark, held: pa.Table, small: Side, large: Side, chunk: slice, live, k, dim, by, exclude_self, prune, arrow):
    """Stream queries past a chunk of the pool: their answers are made where they lie."""
    held = held.combine_chunks()
    block = held.column("__block").to_numpy()
    parts = []
    for b in np.unique(block):
        rows = held.filter(pa.array(block == b))
        parts.append((small.centre[b], small.radius[b], ids_of(rows.column(0)), matrix(rows.column(1), dim, narrow=True), ids_of(rows.column(2)) if by else None))
    shared = spark.sparkContext.broadcast((parts, live, large.bound))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, live, bound = shared.value
        centres, radii = np.stack([p[0] for p in parts]), np.array([p[1] for p in parts])
        most = max(1, BLOCK_ROWS * len(parts) // max(1, sum(len(p[2]) for p in parts)))
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            for b, rows in _by_block(batch, names.index("__block")):
                if not live[b]:
                    continue
                v, kth = matrix(rows.column(1), dim, narrow=True), rows.column(names.index("__kth")).to_numpy()
                running = Running(ids_of(rows.column(0)), v, k, exclude_self)
                if prune:
                    reach = v @ centres.T + np.linalg.norm(v.astype(np.float64), axis=1)[:, None] * radii
                    # the most promising blocks come first and raise the bounds for the others, which come many at once
                    order, at, many = np.argsort(-reach.max(axis=0)), 0, 1
                    while at < len(order):
                        chosen = order[at : at + many]
                        at, many = at + many, min(2 * many, most)
                        least = np.maximum(np.maximum(kth, bound[b]), running.kth()) - _SLACK
                        near = reach[:, chosen] >= least[:, None]
                        who, met = np.flatnonzero(near.any(axis=1)), [parts[i] for i in chosen[near.any(axis=0)]]
                        if len(who):
                            running.add(np.concatenate([p[2] for p in met]), np.concatenate([p[3] for p in met]), None, who, least[who])
                else:
                    for _, _, pid, mat, cls in parts:
                        running.add(pid, mat, cls)
                for made in running.batches(arrow):
                    yield pa.RecordBatch.from_arrays([*made.columns, pa.array(np.full(made.num_rows, b, "int32"))], [*arrow.names, "__block"])

    return run


def _past_queries(spark, held: pa.Table, small: Side, large: Side, chunk: slice, live, k, dim, by, exclude_self, prune, arrow):
    """Stream the pool past a chunk of queries: each task keeps the queries' best rows so far."""
    shared = spark.sparkContext.broadcast(
        (ids_of(held.column(0)), matrix(held.column(1), dim, narrow=True), held.column("__kth").to_numpy(), large.centre, large.radius, live)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, v, kth, centre, radius, live = shared.value
        running, long = Running(qid, v, k, exclude_self), np.linalg.norm(v.astype(np.float64), axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            for b, rows in _by_block(batch, batch.schema.names.index("__block")):
                if not live[b]:
                    continue
                who = floor = None
                if prune:
                    least = np.maximum(kth, running.kth()) - _SLACK
                    who = np.flatnonzero(v @ centre[b] + long * radius[b] >= least)
                    if not len(who):
                        continue
                    floor = least[who]
                running.add(ids_of(rows.column(0)), matrix(rows.column(1), dim, narrow=True), ids_of(rows.column(2)) if by else None, who, floor)
        for made in running.batches(arrow):
            yield pa.RecordBatch.from_arrays([*made.columns, pa.array(np.full(made.num_rows, -1, "int32"))], [*arrow.names, "__block"])

    return run
