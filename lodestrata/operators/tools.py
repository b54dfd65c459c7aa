"""Whole answers: what the public tools return, put together from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import changes, graph, structure, telemetry, text
from lodestrata.plans.spread import dealt, unbroadcast


def session_report(calls: DataFrame) -> DataFrame:
    """Savings by tool, category and intent as rows (section, key, n, saved or returned)."""
    a = telemetry.by_tool(calls).select(F.lit("tool").alias("section"), F.col("tool").alias("key"), F.col("n_calls").alias("n"), F.col("saved").alias("value"))
    b = telemetry.by_category(calls).select(F.lit("category").alias("section"), F.col("category").alias("key"), F.col("n_calls").alias("n"), F.col("saved").alias("value"))
    c = telemetry.by_intent(calls).select(F.lit("intent").alias("section"), F.col("intent").alias("key"), F.col("n_calls").alias("n"), F.col("returned").alias("value"))
    return a.unionByName(b).unionByName(c)


def session_budget(events: DataFrame, budget: int, base: int = 300) -> DataFrame:
    """Burn, what it leaves, and the threshold for reads that follows."""
    b = telemetry.budget_burn(events, budget)
    return b.withColumn("threshold", telemetry.effective_threshold(F.col("burn"), F.lit(base)))


def edit_slice(symbols: DataFrame, n_lines: Column, context: int = 5, most: int = 60) -> DataFrame:
    """The range to show before an edit: the symbol, or its first lines, with context inside the file."""
    shown = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(most))
    return symbols.withColumn("lo", F.greatest(F.lit(1), F.col("start_line") - context)).withColumn("hi", F.least(n_lines, F.col("start_line") + shown - 1 + context))


def code_audit(ls: DataFrame, limit: int = 50) -> DataFrame:
    """Task marks by kind; the limit holds before the grouping, in order of path and line."""
    hits = text.marked_lines(ls).orderBy("path", "line_no").limit(limit)
    return hits.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("path").alias("n_files"))


def directory_outline(files: DataFrame, symbols: DataFrame, depth: int = 2) -> DataFrame:
    """Files and top-level symbols of each folder down to a depth."""
    n = symbols.where("parent is null").groupBy("path").agg(F.count("*").alias("s"))
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(depth))), "/")
    return files.select("path").join(n, "path", "left").groupBy(folder.alias("dir")).agg(F.count("*").alias("n_files"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_symbols"))


def diff_report(parsed: DataFrame, symbols: DataFrame, parts: int | None = None) -> DataFrame:
    """Changed files of a diff with the symbols that its hunks touch. parts: of how many tasks, if it is known."""
    h = changes.hunks(parsed)
    hit = changes.affected_symbols(h.select("path", "new_start", "new_count", (F.col("added") > 0).alias("has_added"), (F.col("removed") > 0).alias("has_removed")), symbols, parts)
    names = hit.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(" "), "change"))), ",").alias("symbols"))
    return unbroadcast(dealt(changes.file_diffs(parsed), parts, "path")).join(unbroadcast(names), "path", "left").select("path", "added", "removed", "symbols")


def area(files: DataFrame, folder: str) -> DataFrame:
    """What the files of a folder import, inside and outside the project, and their tests."""
    ls = text.lines(files.where(F.col("path").startswith(folder.rstrip("/") + "/")))
    imp = structure.import_rows(ls).select(graph.import_kind(F.col("source")).alias("section"), F.when(F.col("source").startswith("."), F.col("source")).otherwise(graph.package_name(F.col("source"))).alias("item"))
    tests = files.where(F.col("path").rlike(graph.TEST_PATH)).select(F.lit("test").alias("section"), F.col("path").alias("item"))
    return imp.unionByName(tests).distinct()
