"""Exact top-k by dot product of pre-normalised vectors.

Exactness means every query meets every pool row, so the work is a matrix product;
what is left to choose is how the two sides meet. Sizes are measured first:

``stream_pool``     the queries fit a bounded broadcast; the pool is scanned once,
                    never shuffled, and each task keeps a running top-k.
``stream_queries``  the pool fits; every query is answered where it lies, no merge.
``rounds``          neither fits; the smaller side is broadcast chunk by chunk, the
                    larger one streamed where it is stored (``operators.rounds``).

No plan emits pairs: a task hands on at most k rows per (query, class).
Sizes count ids with their text length. Ties: ``operators.topk``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.operators.rounds import in_rounds
from assaykit.operators.topk import BLOCK_ROWS, Running, ids_of, matrix

BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20


def _arrow_type(t: T.DataType) -> pa.DataType:
    types = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.ShortType(): pa.int16(), T.ByteType(): pa.int8()}
    if t not in types:
        raise TypeError(f"ids and classes must be integers or strings, not {t.simpleString()}")
    return types[t]


def _measured(df: DataFrame, key: str) -> tuple[int, int]:
    """Rows, and the bytes of their ids beyond a number's; only the id column is read."""
    length = F.octet_length(key) if isinstance(df.schema[key].dataType, T.StringType) else F.lit(0)
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(length.cast("long")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def nearest(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    query_id: str = "query_id",
    pool_id: str = "pool_id",
    vector: str = "embedding",
    by: str | None = None,
    exclude_self: bool = False,
    strategy: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int | None = None,
    dim: int | None = None,
    chunk_bytes: int | None = None,
    prune: bool = True,
    on_round: Callable[[int, int, int], None] | None = None,
) -> DataFrame:
    """The ``k`` most similar pool rows per query — per (query, ``by``) when given.

    Columns: query_id, pool_id, sim, rank [, by]; rank 1 is the nearest. A pool smaller
    than k gives all of it. ``exclude_self`` skips a pool row with the query's own id.
    ``dim`` saves looking at a row when the vectors are computed, not stored. In rounds, which
    run at once, a block holds about ``block_rows`` rows (by default ``BLOCK_BYTES``), a chunk
    ``chunk_bytes`` (by default ``broadcast_bytes``), and where that makes many chunks a round takes several; ``prune`` only changes what is read, and
    ``on_round`` is told (round, blocks read, blocks there are).
    """
    if k < 1:
        raise ValueError("k must be positive")
    q = queries.select(query_id, vector)
    p = pool.select(pool_id, vector, *([by] if by else []))
    if exclude_self and q.schema[query_id].dataType != p.schema[pool_id].dataType:
        raise TypeError("exclude_self needs ids of one type")
    spark = q.sparkSession
    # counting prunes the vector column; lengths are read off one row and checked in the tasks
    (n_q, ids_q), (n_p, ids_p) = (_measured(df, c) for df, c in ((q, query_id), (p, pool_id)))
    if dim is None:
        firsts = (df.select(F.size(vector)).first() for df in (q, p))
        dims = {row[0] for row in firsts if row is not None}
        if len(dims) > 1:
            raise ValueError(f"vectors differ in length: {sorted(dims)}")
        dim = dims.pop() if dims else 0
    bytes_q, bytes_p = (n * (dim * 8 + 64) + ids for n, ids in ((n_q, ids_q), (n_p, ids_p)))
    if strategy is None:
        if min(bytes_q, bytes_p) > broadcast_bytes:
            strategy = "rounds"
        else:
            strategy = "stream_pool" if bytes_q <= bytes_p else "stream_queries"

    fields = [
        T.StructField(query_id, q.schema[query_id].dataType),
        T.StructField(pool_id, p.schema[pool_id].dataType),
        T.StructField("sim", T.DoubleType()),
        *([T.StructField(by, p.schema[by].dataType)] if by else []),
    ]
    schema = T.StructType(fields)
    arrow = pa.schema(
        [(f.name, pa.float64() if f.name == "sim" else _arrow_type(f.dataType)) for f in fields]
    )

    def classes(table: pa.Table | pa.RecordBatch) -> np.ndarray | None:
        return ids_of(table.column(2)) if by else None

    if strategy == "stream_pool":
        small = q.toArrow()
        held = spark.sparkContext.broadcast((ids_of(small.column(0)), matrix(small.column(1), dim, narrow=True) if len(small) else np.empty((0, dim))))

        def scan_pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            running = Running(*held.value, k, exclude_self)
            for b in batches:
                if b.num_rows:
                    running.add(ids_of(b.column(0)), matrix(b.column(1), dim, narrow=True), classes(b))
            yield from running.batches(arrow)

        found = p.mapInArrow(scan_pool, schema)
    elif strategy == "stream_queries":
        small = p.toArrow()
        held = spark.sparkContext.broadcast(
            (
                ids_of(small.column(0)),
                matrix(small.column(1), dim, narrow=True) if len(small) else np.empty((0, dim)),
                classes(small),
            )
        )

        def scan_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    running = Running(ids_of(b.column(0)), matrix(b.column(1), dim, narrow=True), k, exclude_self)
                    running.add(*held.value)
                    yield from running.batches(arrow)

        found = q.mapInArrow(scan_queries, schema)
    elif strategy == "rounds":
        rows = block_rows or max(1, min(BLOCK_ROWS, BLOCK_BYTES // (dim * 8 + 64)))
        if n_q and n_p:
            found = in_rounds(q, p, k, query_id, pool_id, vector, by, exclude_self, dim, (n_q, n_p), schema, arrow, rows, chunk_bytes or broadcast_bytes, prune, on_round, broadcast_bytes)
        else:
            found = spark.createDataFrame([], schema)
    else:
        raise ValueError(f"unknown strategy: {strategy!r}")

    order = Window.partitionBy(query_id, *([by] if by else [])).orderBy(F.col("sim").desc(), F.col(pool_id).asc())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
