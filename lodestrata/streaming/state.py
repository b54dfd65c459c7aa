"""Stateful operators, as streams and as batches that give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def session_totals(events: DataFrame) -> DataFrame:
    """Running totals per session: a stream of them runs in update or complete mode."""
    return events.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("tokens_returned").alias("returned"))


def debounced(events: DataFrame, at: str = "at", gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """Bursts of changes to a file: one row per burst, which ends when nothing came for the gap. Rows later than the watermark are dropped by a stream."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    g = e.groupBy("file", F.session_window(F.col(at), gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("file", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def registry(loads: DataFrame) -> DataFrame:
    """The last load of each slot (path, kind, symbol); all ranges of a file share one slot."""
    symbol = F.when(F.col("kind") == "range", F.lit(None)).otherwise(F.col("symbol"))
    return loads.groupBy("session_id", "path", "kind", symbol.alias("symbol")).agg(F.max_by(F.struct("content_hash", "loaded_at"), F.struct("loaded_at", "event_id")).alias("l")).select("session_id", "path", "kind", "symbol", "l.content_hash", "l.loaded_at")


def loads_seen(loads: DataFrame, fresh_ms: int = 120_000) -> DataFrame:
    """How each load of a file is answered: a reminder if its content was loaded before, the names that changed if that is recent, else the content."""
    w = Window.partitionBy("session_id", "path").orderBy("loaded_at", "event_id")
    was, at = F.lag("content_hash").over(w), F.lag("loaded_at").over(w)
    how = F.when(was.isNull() | (was == ""), "content").when(was == F.col("content_hash"), "reminder").when(F.col("loaded_at") - at < fresh_ms, "delta").otherwise("content")
    return loads.select("event_id", how.alias("answer"))


def prepared(marks: DataFrame, edits: DataFrame, ttl_ms: int = 1_800_000) -> DataFrame:
    """Whether an edit's file was marked less than the time to live before: the last mark before each edit by one window over both."""
    both = marks.select("path", "ts", F.lit(None).cast("long").alias("edit_id")).unionByName(edits.select("path", "ts", F.col("event_id").alias("edit_id")))
    w = Window.partitionBy("path").orderBy("ts", F.col("edit_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("edit_id").isNull(), F.col("ts"))).over(w)
    return both.select("edit_id", "ts", last.alias("m")).where("edit_id is not null").select(F.col("edit_id").alias("event_id"), F.coalesce(F.col("ts") - F.col("m") < ttl_ms, F.lit(False)).alias("prepared"))


def invalidated(entries: DataFrame, changed: DataFrame) -> DataFrame:
    """Cache entries (entry, dep) that a changed path touches: an equal dependency, or a folder, written with a slash, that holds it.

    The folders above each changed path are listed, so that both cases are one equal join.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
    touched = changed.select(F.explode(F.concat(F.array("path"), F.when(F.size(parts) > 1, folders).otherwise(F.array().cast("array<string>")))).alias("dep")).distinct()
    return entries.join(touched, "dep", "left_semi").select("entry").distinct()


def evicted(entries: DataFrame, keep: int = 200) -> DataFrame:
    """Entries beyond the newest `keep` of each tool."""
    w = Window.partitionBy("tool").orderBy(F.desc("cached_at"), F.desc("event_id"))
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > keep).drop("_n")


def lru_bytes(files: DataFrame, most: int) -> DataFrame:
    """Files that a cache of so many bytes still holds, the last used first."""
    w = Window.partitionBy("cache").orderBy(F.desc("used_at"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("held", F.sum("size").over(w)).where(F.col("held") <= most).select("cache", "id", "held")


def near_budget(events: DataFrame, budget: int, share: float = 0.9) -> DataFrame:
    """Workflows that have used so much of their budget."""
    return events.where("workflow_id is not null").groupBy("workflow_id").agg(F.sum("est_tokens").alias("used")).where(F.col("used") >= share * budget)


def interceptions(reads: DataFrame, threshold: int) -> DataFrame:
    """Reads over the threshold, and what a summary of them saves; stateless, so the same on a stream."""
    return reads.where(F.col("est_tokens") > threshold).select("event_id", "file", F.greatest(F.lit(0), F.col("est_tokens") - F.col("summary_tokens")).alias("saved_tokens"))


def recent(events: DataFrame, now: int, span_ms: int) -> DataFrame:
    return events.where((F.col("ts") > now - span_ms) & (F.col("ts") <= now))
