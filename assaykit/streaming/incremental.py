"""Incremental answer scoring: new answer files are parsed once and appended per run.

What has been answered is keyed state: the (run, image_file) pairs in Spark's state store, looked up without Python. A micro-batch looks up its own
keys and writes their new records; it never reads the sink, so its cost does not grow with what the sink holds. State
and offsets are versioned together by the checkpoint, and the sink lists the files of each batch in its own log, so a
batch that is run again, after a lost driver too, finds the state as it was before and adds nothing twice.

Texts are nearly all of the bytes. They cross the two exchanges of a batch packed one by one, the sink holds them in zstd,
and a batch's shuffle files go when it ends.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from assaykit import schemas
from assaykit.fixed_values import SUBTYPES
from assaykit.functions.answers import parse
from assaykit.session import SHUFFLES_END, settings
from assaykit.sources.results import INGEST, ingest_place

KEYS = ["run", "image_file"]
PLACE = ["time", "file", "block", "line"]  # ingest order
HELD_BYTES = 16 << 20  # answers that a task holds in memory before they go to its file
PIECE_BYTES = 16 << 20  # texts that are unpacked at once
PACKED = ["packed", "n_bytes"]  # a text in zstd and its length in UTF-8
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # else each of the many small stores takes 8 MB of disk ahead of use
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of a task in ``line`` and pack their texts, each by itself since rows part at the exchange."""
    codec, seen = pa.Codec("zstd", compression_level=1), 0
    for b in batches:
        line = pa.array(np.arange(seen, seen + b.num_rows))
        seen += b.num_rows
        texts = [t.as_buffer() for t in b.column("raw_text")]
        packed = pa.array([None if t is None else codec.compress(t, asbytes=True) for t in texts], pa.binary())
        size = pa.array([None if t is None else t.size for t in texts], pa.int64())
        kept = [c for c in b.schema.names if c != "raw_text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), packed, size, line], [*kept, *PACKED, "line"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers with their texts again, in pieces of bounded size."""
    codec = pa.Codec("zstd")
    for b in batches:
        begun, held, texts = 0, 0, []
        for packed, size in zip(b.column("packed"), b.column("n_bytes").to_pylist()):
            # a frame of an empty text has nothing to unpack
            texts.append(codec.decompress(packed.as_buffer(), size, asbytes=True) if size else None if size is None else b"")
            held += size or 0
            if held >= PIECE_BYTES or begun + len(texts) == b.num_rows:
                piece, begun = b.slice(begun, len(texts)), begun + len(texts)
                columns = {c: piece.column(c) for c in piece.schema.names} | {"raw_text": pa.array(texts, pa.binary()).view(pa.string())}
                held, texts = 0, []
                yield pa.RecordBatch.from_arrays([columns[c] for c in schemas.ANSWERS.names], schemas.ANSWERS.names)


def answer_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Answers as they arrive, texts packed, each with the place it was read from and its ``line`` among those of its task."""
    stream = spark.readStream.schema(schemas.ANSWERS).option("maxFilesPerTrigger", files_per_batch).json(folder)
    placed = stream.withColumn(INGEST, F.struct(*ingest_place()))
    kept = [f for f in placed.schema.fields if f.name != "raw_text"]
    added = [T.StructField("packed", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("line", T.LongType())]
    return placed.mapInArrow(_packed, T.StructType([*kept, *added]))


def _last(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each key in a task's rows the last by ingest order, cut to the columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latest: dict[tuple, tuple] = {}
        # texts wait in a file of the task's own, so that it holds no more than the keys and their places
        with tempfile.SpooledTemporaryFile(max_size=HELD_BYTES) as held:
            writer, row = None, 0
            for b in batches:
                writer = writer or pa.ipc.new_stream(held, b.schema)
                writer.write_batch(b)
                time = b.column(b.schema.get_field_index("time")).cast(pa.int64())
                columns = [time, *(b.column(b.schema.get_field_index(c)) for c in (*PLACE[1:], *KEYS))]
                for *place, run, image in zip(*(c.to_pylist() for c in columns)):
                    now = (*place, row)
                    if (run, image) not in latest or latest[run, image] < now:
                        latest[run, image] = now
                    row += 1
            if writer is None:
                return
            writer.close()
            held.seek(0)
            kept, begun = np.sort(np.fromiter((now[-1] for now in latest.values()), np.int64, len(latest))), 0
            for b in pa.ipc.open_stream(held):
                at = kept[slice(*np.searchsorted(kept, (begun, begun + b.num_rows)))] - begun
                begun += b.num_rows
                if len(at):
                    yield b.select(names).take(pa.array(at))

    return run


def new_answers(stream: DataFrame) -> DataFrame:
    """One answer for each (run, image_file) that comes for the first time; later batches never change it.

    Rows of a key meet in one task, which leaves the batch's last of them; keys that came in an earlier batch are dropped by the state store.
    """
    known = stream.filter(F.col("image_file").isNotNull() & F.col("run").isNotNull())
    names = [*KEYS, *PACKED, *(c for c in schemas.ANSWERS.names if c not in (*KEYS, "raw_text"))]
    flat = known.select(*names, *[F.col(f"{INGEST}.{c}").alias(c) for c in PLACE[:3]], "line")
    out = T.StructType([flat.schema[c] for c in names])
    return flat.repartition(*KEYS).mapInArrow(_last(names), out).dropDuplicates(KEYS).mapInArrow(_unpacked, schemas.ANSWERS)


def records(answers: DataFrame) -> DataFrame:
    """Parsed records with their predictions named as in a result log."""
    parsed = parse(answers, "raw_text")
    return parsed.withColumnsRenamed({"any_hem": "pred_any_hem", **{k: f"pred_{k}" for k in SUBTYPES}})


def score_incrementally(
    spark: SparkSession, source: str, sink: str, checkpoint: str, available_now: bool = True, files_per_batch: int = 1000
) -> StreamingQuery:
    """Start the job; with ``available_now`` it ends after the files present at start.

    Inside a micro-batch the last answer by ingest order counts; a key that came in an earlier one is settled. Answers without a
    run or an image are left out. The state store is RocksDB, which keeps keys on disk.
    """
    with settings(spark, _ROCKS | SHUFFLES_END):
        writer = (
            records(new_answers(answer_stream(spark, source, files_per_batch)))
            .writeStream.format("parquet")
            .outputMode("append")
            .partitionBy("run")
            .option("compression", "zstd")
            .option("path", sink)
            .option("checkpointLocation", checkpoint)
        )
        return (writer.trigger(availableNow=True) if available_now else writer).start()
