"""Text encoding without a model: hashed term counts, unit length.

A stand-in for a sentence encoder (which a user supplies through ``images.embed``).
Term slots come from md5, so the vectors are the same in any engine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaykit.functions.keyed import hash_slot

DIM = 64
STEP = 1 << 18  # terms counted at once


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def encode(df: DataFrame, text: str = "text", out: str = "embedding", dim: int = DIM) -> DataFrame:
    """Append array<float>: term counts by slot, L2-normalised (all zero without terms).

    Splitting and hashing stay in the JVM; one Arrow pass counts the slots, ``STEP`` terms at a time however long the texts.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for slots in batches:
            table = slot_counts(slots, dim)
            size = np.sqrt((table * table).sum(axis=1, keepdims=True))
            unit = np.divide(table, size, out=np.zeros_like(table), where=size > 0).astype(np.float32)
            ends = np.arange(0, unit.size + 1, dim, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(unit.ravel()))

    slots = F.transform(F.coalesce(terms(F.col(text)), F.array().cast("array<string>")), lambda t: hash_slot(F.md5(t), dim))
    return df.withColumn(out, count(slots))


def slot_counts(slots: pa.ListArray, dim: int) -> np.ndarray:
    """A row of ``dim`` counts for each list of slots."""
    flat, ends = slots.flatten(), np.cumsum(slots.value_lengths().to_numpy(zero_copy_only=False))
    table = np.zeros((len(slots), dim))
    for at in range(0, len(flat), STEP):
        part = flat.slice(at, STEP).to_numpy(zero_copy_only=False)
        row = np.searchsorted(ends, np.arange(at, at + len(part)), side="right")
        first, last = row[0], row[-1] + 1
        table[first:last] += np.bincount((row - first) * dim + part, minlength=(last - first) * dim).reshape(-1, dim)
    return table
