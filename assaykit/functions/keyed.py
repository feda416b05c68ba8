"""Keyed draws: randomness as a pure function of (seed, key).

``rand()`` depends on partitioning and on task retries. A draw keyed by the row's
own id gives the same answer on any cluster layout, after a lost executor, and in
any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKET_DIGITS = 3


def key_hash(seed: int | str | Column, *keys: str | Column) -> Column:
    """md5 hex of ``seed|key|key…``; hex order equals numeric order."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    cols = [k if isinstance(k, Column) else F.col(k) for k in keys]
    return F.md5(F.concat_ws("|", head.cast("string"), *[c.cast("string") for c in cols]))


def hash_bucket(h: Column) -> Column:
    """Leading hex digits, 4096 values; sorting by them is a prefix of sorting by ``h``."""
    return F.substring(h, 1, BUCKET_DIGITS)


def hash_slot(h: Column, n: int) -> Column:
    """A slot in [0, n): from the leading hex digits for n up to 4096, from 60 bits beyond."""
    if n > 16**BUCKET_DIGITS:
        return F.pmod(hash_long(h), F.lit(n)).cast("int")
    return F.pmod(F.conv(hash_bucket(h), 16, 10).cast("int"), F.lit(n))


def hash_long(h: Column) -> Column:
    """60 bits of the hash as a non-negative long."""
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def draw_indices(n: Column, k: int, seed: int | str | Column, *keys: str | Column) -> Column:
    """``min(k, n)`` distinct positions in [0, n), in random order, keyed by (seed, keys).

    Draw ``i`` picks a rank among the ``n - i`` positions left; stepping over the
    earlier picks in ascending order turns the rank into a position. Costs O(k²)
    per row and never looks at the n candidates themselves.
    """
    n = n.cast("long")

    def step(acc: Column, i: Column) -> Column:
        rank = F.pmod(hash_long(key_hash(seed, *keys, i)), n - i.cast("long"))
        position = F.aggregate(
            F.array_sort(acc), rank, lambda v, p: v + F.when(v >= p, F.lit(1)).otherwise(F.lit(0)).cast("long")
        )
        return F.concat(acc, F.array(position))

    steps = F.sequence(F.lit(0), F.least(F.lit(k).cast("long"), n).cast("int") - F.lit(1))
    empty = F.array().cast("array<bigint>")
    return F.when(n.isNull() | (n <= 0) | F.lit(k <= 0), empty).otherwise(F.aggregate(steps, empty, step))

