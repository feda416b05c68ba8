"""Batch scoring in committed waves: a job that is lost keeps every wave it finished.

The work left is cut into waves by key hash and stored once, so a wave reads its own part. Each wave is scored, written
to a folder of its own, and then recorded in the log: one file, made under another name and renamed, so that a wave is
either in the log with all its rows or not there. A folder without a record is an attempt that was lost, and nobody reads it.

Resuming reads the keys of recorded waves only, leaves them out, and cuts what is left anew; a longer manifest or another size of
wave is no obstacle. Two jobs on one log would ask twice, but a record is never overwritten.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.keyed import hash_slot, key_hash
from assaykit.operators.scoring import ScoreFn, result_records, score
from assaykit.operators.splits import todo

WAVE_ROWS = 100_000


class WaveLog:
    """The records of finished waves, in order, as files ``_log/<number>.json`` below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        place = self._path(f"{self.folder}/_log")
        if not self._fs.exists(place):
            return []
        return sorted(n for f in self._fs.listStatus(place) if (n := f.getPath().getName()).endswith(".json") and not n.startswith((".", "_")))

    def entries(self) -> list[dict]:
        """One record a wave; a run of any size has (rows / wave rows) of them."""
        names = self._names()
        if not names:
            return []
        lines = self.spark.read.text([f"{self.folder}/_log/{n}" for n in names]).collect()
        return sorted((json.loads(r.value) for r in lines), key=lambda e: e["number"])

    def commit(self, attempt: str, rows: int, number: int) -> None:
        """Record an attempt; raises if another job has recorded this number."""
        line = json.dumps({"number": number, "attempt": attempt, "rows": rows})
        draft, final = (self._path(f"{self.folder}/_log/{n}") for n in (f"_{uuid.uuid4().hex}", f"{number:08d}.json"))
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(line.encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"wave {number} of {self.folder} was recorded by another job")

    def records(self) -> DataFrame | None:
        """Rows of all recorded waves; None before the first."""
        done = [e["attempt"] for e in self.entries() if e["rows"]]
        return self.spark.read.parquet(*[f"{self.folder}/{a}" for a in done]) if done else None


def score_in_waves(
    manifest: DataFrame, make_score_fn: Callable[[], ScoreFn], run: str, folder: str, key: str = "image_file",
    carry: Sequence[str] = ("patient", "slice"), wave_rows: int = WAVE_ROWS, on_commit: Callable[[dict], None] | None = None,
) -> DataFrame:
    """Answer every manifest row that the log in ``folder`` doesn't hold, wave by wave, and return all records of the run.

    Call it again after a failure: finished waves are not asked again. Of a failed wave at most ``wave_rows`` answers are lost.
    ``make_score_fn`` and the records are those of ``operators.scoring``.
    """
    spark = manifest.sparkSession
    log = WaveLog(spark, folder)
    done = log.records()
    work = manifest if done is None else todo(manifest, done, [key])
    waves = max(1, math.ceil(work.count() / wave_rows))
    path = f"{log.folder}/_work/{uuid.uuid4().hex}"
    cut = work.withColumn("__wave", hash_slot(key_hash(run, key), waves))
    cut.repartition("__wave", F.pmod(F.xxhash64(key), F.lit(64))).write.partitionBy("__wave").parquet(path)
    stored = spark.read.schema(cut.schema).parquet(path)
    first = 1 + max((e["number"] for e in log.entries()), default=-1)
    for wave in range(waves):
        attempt = f"attempt-{uuid.uuid4().hex}"
        answers = score(stored.where(F.col("__wave") == wave).drop("__wave"), make_score_fn, key, carry)
        result_records(answers, run).write.parquet(f"{log.folder}/{attempt}")
        rows = spark.read.parquet(f"{log.folder}/{attempt}").count()
        log.commit(attempt, rows, first + wave)
        if on_commit:
            on_commit({"number": first + wave, "rows": rows})
    found = log.records()
    return result_records(score(work.limit(0), make_score_fn, key, carry), run) if found is None else found
