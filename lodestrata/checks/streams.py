"""Queries of the stateful operators: batch twins, and streams run to the end of a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.plans.scratch import scratch_path
from lodestrata.plans.spread import parts_of
from lodestrata.sources import rotating
from lodestrata.sources.adapters import duck, per_customer, per_customer_sql, table, view
from lodestrata.streaming import state as t
from lodestrata.streaming import ttl

CALLS, EVENTS = duck("tool_calls"), duck("hook_events")
LOADS = EVENTS + ", loads AS (SELECT event_id, session_id, file AS path, CASE WHEN k % 3 = 0 THEN 'range' ELSE 'symbol' END AS kind, 'y' || (k % 4)::VARCHAR AS symbol, 'h' || (k % 3)::VARCHAR AS content_hash, ts AS loaded_at FROM hook_events)"


def _events(spark, sf):
    return view(spark, sf, "hook_events")


def _loads(spark, sf):
    k = F.col("k")
    return _events(spark, sf).select("event_id", "session_id", F.col("file").alias("path"), F.when(k % 3 == 0, "range").otherwise("symbol").alias("kind"), F.concat(F.lit("y"), (k % 4).cast("string")).alias("symbol"), F.concat(F.lit("h"), (k % 3).cast("string")).alias("content_hash"), F.col("ts").alias("loaded_at"))


query("e02_session_totals", f"{CALLS} SELECT session_id, count(*) AS n, CAST(sum(tokens_returned) AS BIGINT) AS returned FROM tool_calls GROUP BY session_id")(lambda s, d: t.session_totals(view(s, d, "tool_calls")))


@query("e02_session_totals_stream", "SELECT user_id AS session_id, count(*) AS n, CAST(sum(floor(value)) AS BIGINT) AS returned FROM events GROUP BY user_id")
def e02_stream(spark, sf):
    """The same totals by a stream over the events' files, run until they are read; the sink is a table in memory."""
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    src = spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else f"{sf}/events.parque[t]")  # a stream reads a folder or a pattern
    name = "t" + uuid.uuid4().hex
    out = t.session_totals(src.select(F.col("user_id").alias("session_id"), F.floor("value").cast("long").alias("tokens_returned")))
    out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _is_folder(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query("e03_debounce", """WITH f AS (SELECT event_id % 97 AS file, ts, event_id FROM events), d AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS s FROM f WINDOW w AS (PARTITION BY file ORDER BY ts, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY file ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM d)
SELECT 'f' || file AS file, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS n FROM g GROUP BY file, g.n""")
def e03(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 97).cast("string")).alias("file"), F.col("ts").cast("timestamp").alias("at"))
    return t.debounced(e, gap="3600 seconds").select("file", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


query("e05_context_registry", f"""{LOADS} SELECT session_id, path, kind, CASE WHEN kind <> 'range' THEN symbol END AS symbol, arg_max(content_hash, loaded_at * 1000000 + event_id) AS content_hash, max(loaded_at) AS loaded_at FROM loads GROUP BY 1, 2, 3, 4""")(lambda s, d: t.registry(_loads(s, d)))
query("e06_loads_seen", f"""{LOADS}, l AS (SELECT *, lag(content_hash) OVER w AS was, lag(loaded_at) OVER w AS prev FROM loads WINDOW w AS (PARTITION BY session_id, path ORDER BY loaded_at, event_id))
SELECT event_id, CASE WHEN was IS NULL OR was = '' THEN 'content' WHEN was = content_hash THEN 'reminder' WHEN loaded_at - prev < 36000000 THEN 'delta' ELSE 'content' END AS answer FROM l""")(lambda s, d: t.loads_seen(_loads(s, d), 36_000_000))


@query("e08_edit_prepared", f"""{EVENTS}, m AS (SELECT file, ts FROM hook_events WHERE k % 2 = 0), e AS (SELECT event_id, file, ts FROM hook_events WHERE k % 2 = 1)
SELECT event_id, coalesce(ts - (SELECT max(m.ts) FROM m WHERE m.file = e.file AND m.ts <= e.ts) < 1800000, false) AS prepared FROM e""")
def e08(spark, sf):
    e = _events(spark, sf)
    return t.prepared(e.where("k % 2 = 0").select(F.col("file").alias("path"), "ts"), e.where("k % 2 = 1").select(F.col("file").alias("path"), "ts", "event_id"))


@query("j10_invalidation", per_customer_sql("SELECT * FROM (VALUES (1), (2), (4)) t(entry)", "", "entry"))
def j10(spark, sf):
    e = per_customer(spark, sf, [(1, "src/a.ts"), (2, "src/"), (3, "src/b.ts"), (4, "src/lib/"), (4, "x"), (5, "sr/")], "entry int, dep string", ("dep",), ("entry",))
    return t.invalidated(e, per_customer(spark, sf, [("src/a.ts",), ("src/lib/q/r.ts",), ("top.md",)], "path string", ("path",)))


query("e09_evicted", f"{CALLS} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY tool ORDER BY ts DESC, event_id DESC) AS n FROM tool_calls) q WHERE n > 200")(lambda s, d: t.evicted(view(s, d, "tool_calls").withColumn("cached_at", F.col("ts"))).select("event_id"))
query("e10_lru_bytes", duck("log_files") + " SELECT * FROM (SELECT id % 8 AS cache, id, CAST(sum(size) OVER (PARTITION BY id % 8 ORDER BY mtime DESC, id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS held FROM log_files) q WHERE held <= 20000000")(lambda s, d: t.lru_bytes(view(s, d, "log_files").select((F.col("id") % 8).alias("cache"), "id", "size", F.col("mtime").alias("used_at")), 20_000_000))
query("e13_interceptions", f"{EVENTS} SELECT event_id, file, CAST(greatest(0, est_tokens - summary_tokens) AS BIGINT) AS saved_tokens FROM hook_events WHERE est_tokens > 300")(lambda s, d: t.interceptions(_events(s, d), 300))
query("e14_recent", f"{EVENTS} SELECT event_id FROM hook_events WHERE ts > 1705000000000 - 7200000 AND ts <= 1705000000000")(lambda s, d: t.recent(_events(s, d), 1_705_000_000_000, 7_200_000).select("event_id"))
query("e15_near_budget", f"{EVENTS} SELECT workflow_id, CAST(sum(est_tokens) AS BIGINT) AS used FROM hook_events WHERE workflow_id IS NOT NULL GROUP BY workflow_id HAVING sum(est_tokens) >= 0.9::DOUBLE * 520000")(lambda s, d: t.near_budget(_events(s, d), 520_000))


@query("e08_edit_prepared_stream", f"""{EVENTS}, m AS (SELECT file, ts FROM hook_events WHERE k % 2 = 0), e AS (SELECT event_id, file, ts FROM hook_events WHERE k % 2 = 1)
SELECT event_id, coalesce(ts - (SELECT max(m.ts) FROM m WHERE m.file = e.file AND m.ts <= e.ts) < 1800000, false) AS prepared FROM e""")
def e08_stream(spark, sf):
    """The same by keyed state with timers, in three runs from one checkpoint."""
    e = _events(spark, sf).select(F.lit("p").alias("project"), F.col("file").alias("path"), F.timestamp_millis("ts").alias("at"), (F.col("k") % 2 == 0).alias("is_mark"), "event_id")
    return ttl.by_slices(e, "at", 3, scratch_path(spark, "prepared"), ttl.edits_prepared)


@query("e05_registry_stream", f"""{EVENTS}, l AS (SELECT event_id, session_id, file AS path, ts AS at, CASE WHEN k % 3 = 0 THEN 'range:' ELSE 'symbol:y' || (k % 4) END AS slot, k AS tokens FROM hook_events),
p AS (SELECT l.event_id, b.tokens FROM l JOIN l b ON b.session_id = l.session_id AND b.path = l.path AND (b.at < l.at OR (b.at = l.at AND b.event_id <= l.event_id)) QUALIFY row_number() OVER (PARTITION BY l.event_id, b.slot ORDER BY b.at DESC, b.event_id DESC) = 1)
SELECT event_id, CAST(count(*) AS INTEGER) AS n_slots, CAST(sum(tokens) AS BIGINT) AS token_estimate FROM p GROUP BY event_id""")
def e05_stream(spark, sf):
    """What each load makes of its path's slots, by map state, in two runs from one checkpoint; no path's state ends meanwhile."""
    k = F.col("k")
    e = _events(spark, sf).select("session_id", F.col("file").alias("path"), F.timestamp_millis("ts").alias("at"), F.when(k % 3 == 0, "range").otherwise("symbol").alias("kind"), F.concat(F.lit("y"), (k % 4).cast("string")).alias("symbol"), k.alias("tokens"), "event_id")
    buckets = parts_of(e.count(), ttl.PER_BUCKET)
    return ttl.by_slices(e, "at", 2, scratch_path(spark, "registry"), lambda s: ttl.registry_log(s, 10_000 * 86_400_000, buckets=buckets))


def _logged(spark, sf, **settings):
    """The events as a stream that arrives week by week, each in a run of its own, in a log that rotates."""
    folder = scratch_path(spark, "log")
    log = rotating.RotatingLog(f"{folder}/log", "hook-events", **settings)
    e = _events(spark, sf).select("event_id", "ts", "code", F.floor(F.col("ts") / (7 * 86_400_000)).alias("week"))
    for (week,) in sorted(e.select("week").distinct().collect()):  # a few weeks
        e.where(F.col("week") == week).drop("week").write.mode("append").parquet(f"{folder}/in")
        src = spark.readStream.schema("event_id long, ts long, code string").parquet(f"{folder}/in")
        src.writeStream.foreachBatch(log).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return log.read(spark, "event_id long, ts long, code string")


query("k01_rotating_log", f"{EVENTS} SELECT event_id, ts, code FROM hook_events")(lambda s, d: _logged(s, d, rotate_bytes=1 << 16))
query("k03_error_archives", f"{EVENTS}, w AS (SELECT *, max(ts) OVER (PARTITION BY ts // 604800000) AS last, max(ts) OVER () AS newest FROM hook_events) SELECT event_id, ts, code FROM w WHERE last >= newest - 10 * 86400000::BIGINT")(lambda s, d: _logged(s, d, rotate_bytes=1 << 12, keep_ms=10 * 86_400_000))


SWITCHED = f"""{EVENTS}, l AS (SELECT event_id, session_id, file AS path, ts AS at, ts // 604800000 AS week, CASE WHEN k % 3 = 0 THEN 'range:' ELSE 'symbol:y' || (k % 4) END AS slot, k AS tokens FROM hook_events)"""


@query("e12_switched_branches", SWITCHED + """, p AS (SELECT l.event_id, b.tokens FROM l JOIN l b ON b.session_id = l.session_id AND b.path = l.path AND (b.week = l.week OR NOT ends_with(l.path, '7')) AND (b.at < l.at OR (b.at = l.at AND b.event_id <= l.event_id)) QUALIFY row_number() OVER (PARTITION BY l.event_id, b.slot ORDER BY b.at DESC, b.event_id DESC) = 1)
SELECT event_id, CAST(count(*) AS INTEGER) AS n_slots, CAST(sum(tokens) AS BIGINT) AS token_estimate FROM p GROUP BY event_id""")
def e12(spark, sf):
    """The head is another each week, and with it the content of every path that ends in 7: what was loaded of them before counts no more."""
    k, week = F.col("k"), F.floor(F.col("ts") / (7 * 86_400_000))
    e = _events(spark, sf)
    loads = e.select("session_id", F.col("file").alias("path"), F.timestamp_millis("ts").alias("at"), F.when(k % 3 == 0, "range").otherwise("symbol").alias("kind"), F.concat(F.lit("y"), (k % 4).cast("string")).alias("symbol"), k.alias("tokens"), "event_id")
    heads = e.select(F.lit("p").alias("project"), F.timestamp_millis(week * 7 * 86_400_000).alias("at"), week.cast("string").alias("head")).distinct()
    switches = ttl.branch_switches(heads)
    differ = loads.where(F.col("path").endswith("7")).select(F.lit("p").alias("project"), "path").distinct()
    gone = ttl.invalidations(switches, switches.select("project", "was", "now").join(differ, "project"), loads.select(F.lit("p").alias("project"), "session_id", "path"))
    buckets = parts_of(loads.count(), ttl.PER_BUCKET)
    return ttl.by_slices(loads.unionByName(gone), "at", 2, scratch_path(spark, "switched"), lambda s: ttl.registry_log(s, 10_000 * 86_400_000, buckets=buckets))
