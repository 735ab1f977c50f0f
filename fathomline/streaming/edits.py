"""A stream of edits, applied as upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def newest(edits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last edit of each key: reduced before it is shuffled, so a key of any share of the edits makes no hot task."""
    rest = [c for c in edits.columns if c not in (key, *order)]
    last = edits.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_m"))
    return last.select(*[F.col(c) if c == key else F.col(f"_m.{c}").alias(c) for c in edits.columns])


class EditTable:
    """A table of the last edit of each key, written by a stream as a log with a compacted base.

    A micro-batch writes only its own last edits, as a delta under its number; a repeated batch writes the same delta again,
    so a restart neither loses nor repeats an edit. Every `compact_every` batches base and deltas become a new base, and what
    it replaces is deleted once it is whole, but for the one before, which readers may still have open. Readers take the
    largest finished base and the deltas after it; of each key the last edit counts.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, order: list[str], compact_every: int = 16) -> None:
        self.spark, self.folder, self.key, self.order, self.compact_every = spark, folder.rstrip("/"), key, order, compact_every
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _finished(self, kind: str) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        found = [int(n[len(kind) :]) for n in names if n.startswith(kind) and n[len(kind) :].isdigit()]
        return sorted(n for n in found if self._fs.exists(self._path(f"{self.folder}/{kind}{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        bases = self._finished("base-")
        deltas = [n for n in self._finished("delta-") if not bases or n > bases[-1]]
        paths = [f"{self.folder}/base-{n}" for n in bases[-1:]] + [f"{self.folder}/delta-{n}" for n in deltas]
        if not paths:
            return None
        df = self.spark.read.parquet(*paths)
        return newest(df, self.key, self.order) if deltas else df

    def apply(self, batch: DataFrame, number: int) -> None:
        newest(batch, self.key, self.order).write.mode("overwrite").parquet(f"{self.folder}/delta-{number}")
        deltas, bases = self._finished("delta-"), self._finished("base-")
        if len([n for n in deltas if not bases or n > bases[-1]]) >= self.compact_every:
            self.read().write.mode("overwrite").parquet(f"{self.folder}/base-{number}")
            for kind, old in [*(("base-", n) for n in bases[:-1]), *(("delta-", n) for n in deltas if bases and n <= bases[-1])]:
                self._fs.delete(self._path(f"{self.folder}/{kind}{old}"), True)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Apply all that is there now and return."""
        q = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()


def distinct_events(stream: DataFrame, time: str, keys: list[str], lateness: str) -> DataFrame:
    """The stream without repeated events; an event later than the lateness may be dropped, the state stays bounded."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
