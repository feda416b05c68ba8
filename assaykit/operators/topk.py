"""Similarities of two sides held as matrices: best rows per query, merged as they come.

Similarities are compared after rounding to nine decimals, then by smaller pool id, so equal vectors tie exactly
however the product was blocked.

Once a query knows m rows, a product in single precision rules out nearly all others: only rows that its error
bound leaves open are computed in double precision. The answer is that of the full product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_ROWS = 16384
FIRST_ROWS = 2048  # pool rows that a class is begun with
_CHUNK_CELLS = 1 << 20  # similarities held at once
_PAIR_CELLS = 1 << 20  # numbers gathered at once for pairs left open
_DENSE = 16  # more than one in so many left open: the whole product is cheaper
_SCALE = 1e9
_POS_BITS = 20


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, narrow: bool = False) -> np.ndarray:
    """The vectors in double precision; with ``narrow`` floats stay floats, in half the room."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        raise ValueError("null vector")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * dim:
        raise ValueError(f"vectors must all have {dim} elements")
    if not np.isfinite(flat).all():
        raise ValueError("vectors must be finite")
    return flat.reshape(len(column), dim).astype(np.float32 if narrow and flat.dtype == np.float32 else np.float64)


def ids_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


def best(q: np.ndarray, p: np.ndarray, pid: np.ndarray, m: int, own: np.ndarray | None = None, floor: np.ndarray | None = None):
    """Top-m columns per query row: (rounded similarity, id), best first.

    ``pid`` must be ascending. Missing places are -inf, and so is a pool row whose id equals the query's entry in
    ``own``. Rows below the query's ``floor`` may be left out.
    """
    sims = np.full((len(q), m), -np.inf)
    ids = np.zeros((len(q), m), dtype=pid.dtype)
    if not len(pid):
        return sims, ids
    step = max(1, _CHUNK_CELLS // len(pid))
    if floor is not None:
        # what a sum of rounded products can be off by, for vectors of any length
        lengths, longest = np.linalg.norm(q, axis=1), np.linalg.norm(p, axis=1).max()
        long = lengths * longest
        least = floor - long * (q.shape[1] + 8) * 2.0**-23 - 1e-8
        if long.max(initial=0.0) < 2 ** (62 - _POS_BITS) / _SCALE and max(longest, lengths.max(initial=0.0)) < 1e6:
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
            narrow_q, narrow_p = q.astype(np.float32, copy=False), p.astype(np.float32, copy=False).T
        else:
            floor = None
    for at in range(0, len(q), step):
        upto = min(at + step, len(q))
        if floor is not None:
            flat = np.flatnonzero(narrow_q[at:upto] @ narrow_p >= least[at:upto, None])
            if len(flat) * _DENSE <= (upto - at) * len(pid):
                rows, cols = np.divmod(flat, len(pid))
                _open_pairs(q, p, pid, m, own, floor, rows + at, cols, sims, ids)
                continue
        _whole_product(q, p, pid, own, slice(at, upto), sims, ids)
    return sims, ids


def _whole_product(q, p, pid, own, rows: slice, sims: np.ndarray, ids: np.ndarray) -> None:
    """Similarity and position are packed into one integer so that a partial sort settles ties by the smaller id."""
    width = min(sims.shape[1], len(pid))
    place = (1 << _POS_BITS) - 1 - np.arange(len(pid), dtype=np.int64)
    s = q[rows].astype(np.float64) @ p.astype(np.float64).T
    s *= _SCALE
    np.rint(s, out=s)
    if max(s.max(initial=0.0), -s.min(initial=0.0)) >= 2 ** (62 - _POS_BITS):
        raise ValueError("vectors must be normalised")
    packed = s.astype(np.int64)
    packed <<= _POS_BITS
    packed |= place
    if own is not None:
        packed[own[rows][:, None] == pid[None, :]] = np.iinfo(np.int64).min + 1
    np.negative(packed, out=packed)
    top = np.argpartition(packed, width - 1, axis=1)[:, :width] if width < len(pid) else np.broadcast_to(np.arange(len(pid)), packed.shape)
    top = np.take_along_axis(top, np.argsort(np.take_along_axis(packed, top, 1), axis=1), 1)
    found = np.take_along_axis(s, top, 1) / _SCALE
    if own is not None:
        found[own[rows][:, None] == pid[top]] = -np.inf
    sims[rows, :width] = found
    ids[rows, :width] = pid[top]


def _open_pairs(q, p, pid, m, own, floor, rows, cols, sims: np.ndarray, ids: np.ndarray) -> None:
    if own is not None:
        kept = own[rows] != pid[cols]
        rows, cols = rows[kept], cols[kept]
    s, step = np.empty(len(rows)), max(1, _PAIR_CELLS // max(1, q.shape[1]))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        s[part] = np.einsum("ij,ij->i", q[rows[part]].astype(np.float64), p[cols[part]].astype(np.float64))
    s = np.rint(s * _SCALE) / _SCALE
    kept = s >= floor[rows] - 2 / _SCALE
    rows, cols, s = rows[kept], cols[kept], s[kept]
    order = np.lexsort((cols, -s, rows))
    rows, cols, s = rows[order], cols[order], s[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = rank < m
    sims[rows[kept], rank[kept]] = s[kept]
    ids[rows[kept], rank[kept]] = pid[cols[kept]]


def merge(a, b, m: int):
    sims, ids = np.hstack([a[0], b[0]]), np.hstack([a[1], b[1]])
    order = np.lexsort((ids, -sims), axis=1)[:, :m]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


class Running:
    """Top-m so far for a fixed set of queries, one table per class."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, m: int, exclude_self: bool):
        self.qid, self.q, self.m, self.exclude_self = qid, q, m, exclude_self
        self.best: dict[object, tuple[np.ndarray, np.ndarray]] = {}

    def add(
        self, pid: np.ndarray, p: np.ndarray, cls: np.ndarray | None, who: np.ndarray | None = None, floor: np.ndarray | None = None
    ) -> None:
        """Meet pool rows; only the queries at ``who``, where given, and only rows from their ``floor`` up."""
        who = np.arange(len(self.qid)) if who is None else who
        whole = len(who) == len(self.qid)
        q, qid = (self.q, self.qid) if whole else (self.q[who], self.qid[who])
        for c in [None] if cls is None else np.unique(cls):
            rows = np.arange(len(pid)) if c is None else np.flatnonzero(cls == c)
            rows = rows[np.argsort(pid[rows], kind="stable")]
            at = 0
            while at < len(rows):
                begun = c in self.best
                part = rows[at : at + (BLOCK_ROWS if begun or floor is not None else FIRST_ROWS)]
                at += len(part)
                least = floor
                if begun:
                    kth = self.best[c][0][who, -1]
                    least = kth if floor is None else np.maximum(kth, floor)
                self._take(c, who, best(q, p[part], pid[part], self.m, qid if self.exclude_self else None, least))

    def _take(self, c: object, who: np.ndarray, found: tuple[np.ndarray, np.ndarray]) -> None:
        if c not in self.best:
            self.best[c] = np.full((len(self.q), self.m), -np.inf), np.zeros((len(self.q), self.m), found[1].dtype)
        new = np.flatnonzero(np.isfinite(found[0][:, 0]))
        sims, ids = self.best[c]
        at = who[new]
        merged = merge((sims[at], ids[at]), (found[0][new], found[1][new]), self.m)
        if ids.dtype != merged[1].dtype:  # longer names
            ids = ids.astype(merged[1].dtype)
        sims[at], ids[at] = merged
        self.best[c] = sims, ids

    def kth(self) -> np.ndarray:
        """Similarity of each query's m-th row so far, of any class; -inf before there are m."""
        if not self.best:
            return np.full(len(self.q), -np.inf)
        return np.max([sims[:, -1] for sims, _ in self.best.values()], axis=0)

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for c, (sims, ids) in self.best.items():
            step = max(1, 65536 // self.m)
            for at in range(0, len(self.qid), step):
                keep = np.isfinite(sims[at : at + step])
                qid = np.repeat(self.qid[at : at + step], self.m).reshape(keep.shape)[keep]
                columns = [qid, ids[at : at + step][keep], sims[at : at + step][keep]]
                if len(schema) == 4:
                    columns.append(np.full(len(qid), c))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v.tolist() if v.dtype.kind == "U" else v, type=f.type) for v, f in zip(columns, schema)],
                    schema=schema,
                )
