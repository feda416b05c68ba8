"""Run-time membership filters: a bitmap of hashed keys that sorts out most rows before a join looks at the rest.

The keys are counted, and the bitmap gets BITS_EACH bits for each of them: 2 bytes a key, one row for each 32768 bits. A
row whose bit is not set is certainly no member. Some one in sixteen others has its bit set by another key, so callers check
the rows that pass against the keys themselves. The size is measured: beyond LIMIT_BYTES there is no filter, and every row goes to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.session import written

BITS_EACH = 16
LIMIT_BYTES = 64 << 20
_ROW_BITS = 32768


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(bits))


def key_bitmap(keys: DataFrame, key: str, limit_bytes: int = LIMIT_BYTES) -> tuple[DataFrame, int] | None:
    """(bitmap rows, number of bits) for the stored ``keys``; None where it would be larger than ``limit_bytes``."""
    n = keys.count()
    bits = _ROW_BITS * max(1, -(-n * BITS_EACH // _ROW_BITS))
    if bits // 8 > limit_bytes:
        return None
    at = keys.where(F.col(key).isNotNull()).select(_place(F.col(key), bits).alias("__p"))
    rows = at.groupBy(F.floor(F.col("__p") / _ROW_BITS).alias("__row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("__p") % _ROW_BITS + 1)).alias("__bits"))
    return written(rows, "bitmap"), bits


def may_be_in(df: DataFrame, key: str, bitmap: tuple[DataFrame, int] | None) -> DataFrame:
    """Rows whose key may be one of the bitmap's; all rows without one. Rows are not shuffled."""
    if bitmap is None:
        return df
    rows, bits = bitmap
    place = _place(F.col(key), bits)
    joined = df.withColumn("__row", F.floor(place / _ROW_BITS)).withColumn("__at", (place % _ROW_BITS).cast("int")).join(F.broadcast(rows), "__row")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.col("__at") % 8 + 1)
    return joined.where(byte.bitwiseAND(bit) > 0).select(*df.columns)
