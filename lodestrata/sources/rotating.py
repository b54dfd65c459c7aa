"""Logs that a stream appends to, that rotate by size and whose archives age by the time in their names.

    events.writeStream.foreachBatch(RotatingLog(path, "hook-events")).start()

Each batch is a folder of its own under `current`. Once these hold rotate_bytes, they are written again as files below the
limit and published by one rename as `<stem>.<time>.<first>-<last>`, time being the latest event's and the rest the
batches inside. A batch that comes again is written over itself, or passed over if an archive holds it; a rotation that was cut off
leaves a folder that nobody reads. So a restart at any point changes nothing, and a reader sees each record once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Bytes of an event log and of an error log before they rotate, and how long archives stay.
EVENT_BYTES, ERROR_BYTES, KEEP_MS = 10 << 20, 5 << 20, 30 * 86_400_000


class _Folder:
    """A folder of a file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.at = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at)) if self.fs.exists(self.at) else []

    def _in(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.at, name)

    def bytes_of(self, name: str) -> int:
        return self.fs.getContentSummary(self._in(name)).getLength()

    def delete(self, name: str) -> None:
        self.fs.delete(self._in(name), True)

    def rename(self, name: str, to: str) -> None:
        if not self.fs.rename(self._in(name), self._in(to)):
            raise OSError(f"{name} cannot become {to} in {self.at}")


@dataclass
class RotatingLog:
    """What foreachBatch calls. keep_ms: archives older than the newest event by more go; None keeps all."""

    path: str
    stem: str
    rotate_bytes: int = EVENT_BYTES
    keep_ms: int | None = KEEP_MS
    time: str = "ts"

    def _archives(self, top: _Folder) -> list[tuple[str, int, int]]:
        """(name, time, last batch) of the archives."""
        found = [(n, re.fullmatch(rf"{re.escape(self.stem)}\.(\d+)\.(\d+)-(\d+)", n)) for n in top.names()]
        return [(n, int(m[1]), int(m[3])) for n, m in found if m]

    def _archived(self, spark: SparkSession) -> int:
        """The last batch that an archive holds, or held before it aged: its number stays in a marker's name."""
        top = _Folder(spark, self.path)
        marks = [int(n.rpartition(".")[2]) for n in top.names() if n.startswith(f"{self.stem}.pruned.")]
        return max([-1, *marks, *(last for *_, last in self._archives(top))])

    def _live(self, spark: SparkSession) -> list[int]:
        done = self._archived(spark)
        ids = [int(m[1]) for n in _Folder(spark, f"{self.path}/{self.stem}.current").names() if (m := re.fullmatch(r"batch-(\d+)", n))]
        return sorted(i for i in ids if i > done)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= self._archived(spark):
            return
        batch.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{self.path}/{self.stem}.current/batch-{batch_id}")
        current = _Folder(spark, f"{self.path}/{self.stem}.current")
        live = self._live(spark)
        if sum(current.bytes_of(f"batch-{i}") for i in live) >= self.rotate_bytes:
            self.rotate(spark, live)
        self.prune(spark)

    def rotate(self, spark: SparkSession, batches: list[int]) -> None:
        """Make an archive of batches: a file holds a run of lines of a partition, and none is over the limit unless one line is."""
        ls = spark.read.text([f"{self.path}/{self.stem}.current/batch-{i}" for i in batches])
        ls = ls.select("value", (F.octet_length("value") + 1).cast("long").alias("n"), F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"))
        newest, longest = ls.agg(F.max(F.get_json_object("value", f"$.{self.time}").cast("long")), F.max("n")).first()
        if longest is not None:
            room = max(1, self.rotate_bytes - longest)
            before = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            cut = ls.withColumn("file", F.concat_ws("-", "p", F.floor(before / room)))
            cut.repartition("file").sortWithinPartitions("file", "i").select("value", "file").write.partitionBy("file").mode("overwrite").text(f"{self.path}/{self.stem}.rotating")
            _Folder(spark, self.path).rename(f"{self.stem}.rotating", f"{self.stem}.{newest or 0}.{batches[0]}-{batches[-1]}")
        self._sweep(spark)

    def _sweep(self, spark: SparkSession) -> None:
        """Delete batches that archives hold."""
        done, current = self._archived(spark), _Folder(spark, f"{self.path}/{self.stem}.current")
        for n in current.names():
            if (m := re.fullmatch(r"batch-(\d+)", n)) and int(m[1]) <= done:
                current.delete(n)

    def prune(self, spark: SparkSession, now_ms: int | None = None) -> None:
        """Delete archives whose time is more than keep_ms before the newest archive's, or before now_ms."""
        top = _Folder(spark, self.path)
        archives = self._archives(top)
        if self.keep_ms is None or not archives:
            return
        now = max(t for _, t, _ in archives) if now_ms is None else now_ms
        old = [(n, last) for n, t, last in archives if t < now - self.keep_ms]
        if old:
            mark = f"{self.stem}.pruned.{max(last for _, last in old)}"  # batches in them stay known as written
            top.fs.mkdirs(top._in(mark))
            for n, _ in old:
                top.delete(n)
            for n in top.names():
                if n.startswith(f"{self.stem}.pruned.") and n != mark and int(n.rpartition(".")[2]) < int(mark.rpartition(".")[2]):
                    top.delete(n)

    def read(self, spark: SparkSession, schema: T.StructType | str) -> DataFrame:
        """All records that are kept: archives, and batches that are in none."""
        paths = [f"{self.path}/{n}" for n, *_ in self._archives(_Folder(spark, self.path))] + [f"{self.path}/{self.stem}.current/batch-{i}" for i in self._live(spark)]
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("recursiveFileLookup", "true").json(paths)


def error_log(path: str) -> RotatingLog:
    """The log of errors: smaller, and never over a month old."""
    return RotatingLog(path, "hook-errors", ERROR_BYTES, KEEP_MS)
