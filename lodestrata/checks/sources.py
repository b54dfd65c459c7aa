"""Queries of the sources and sinks: the tables are written as logs, definitions and envelopes, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.checks.telemetry import INTENT_SQL
from lodestrata.operators import graph, telemetry
from lodestrata.plans.scratch import scratch_path
from lodestrata.sources import logs
from lodestrata.sources.adapters import duck, per_customer, per_customer_sql, table, view
from lodestrata.streaming import state

CALLS, EVENTS = duck("tool_calls"), duck("hook_events")


def _as_files(lines: DataFrame, folder: str, stem: str, ending: str = ".jsonl") -> str:
    """Lines (value) as files `<stem>.<n><ending>` of a folder: as many as there are partitions, each renamed once written."""
    spark = lines.sparkSession
    lines.select("value").write.text(f"{folder}.part")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(f"{folder}.part")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    for n, name in enumerate(names):
        fs.rename(path(f"{folder}.part/{name}"), path(f"{folder}/{stem}{f'.{n}' if n else ''}{ending}"))
    return folder


def _json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def _hooks(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "hook_events").select("ts", "session_id", "agent_type", "event", "file", "est_tokens", "code")


HOOKS = f"{EVENTS}, h AS (SELECT ts, session_id, agent_type, event, file, est_tokens, code FROM hook_events)"
_KEPT = ("ts", "session_id", "agent_type", "event", "file", "est_tokens", "code")


@query("s10_hook_events", f"{HOOKS} SELECT * FROM h")
def s10(spark, sf):
    """Every record is followed by a line that is none."""
    rows = _json(_hooks(spark, sf)).select(F.explode(F.array("value", F.lit("{broken"))).alias("value"))
    return logs.events(spark, _as_files(rows, scratch_path(spark, "hooks"), "hook-events")).select(*_KEPT)


@query("s11_event_tree", f"{HOOKS} SELECT * FROM h WHERE ts % 4 < 2")
def s11(spark, sf):
    """Logs of several projects: one that a walk leaves out, and one that lies too deep."""
    top = scratch_path(spark, "tree")
    for k, at in enumerate(("a", "b/.state", "c/node_modules/x", "d/1/2/3/4/5")):
        _as_files(_json(_hooks(spark, sf).where(F.col("ts") % 4 == k)).coalesce(1), f"{top}/{at}", "hook-events")
    return logs.event_tree(spark, top, state=".state").select(*_KEPT)


@query("s12_tool_calls", f"{CALLS} SELECT ts, session_id, tool, path, tokens_returned, tokens_would_be, savings_category, session_cache_hit, delegated FROM tool_calls")
def s12(spark, sf):
    """A current log and its archives, beside a log of another name."""
    calls = view(spark, sf, "tool_calls").drop("event_id")
    folder = _as_files(_json(calls.repartition(4)), scratch_path(spark, "calls"), "tool-calls")
    _as_files(_json(calls), f"{folder}/other", "hook-events")
    return logs.with_archives(spark, folder)


@query("s14_denied_reads", f"{EVENTS} SELECT file AS file_path, CAST(k AS INTEGER) AS line_count, CAST(est_tokens AS INTEGER) AS estimated_tokens, ts FROM hook_events WHERE event = 'denied'")
def s14(spark, sf):
    """Two logs of denied reads; the one with a bad line gives nothing."""
    rows = _json(view(spark, sf, "hook_events").where("event = 'denied'").select(F.col("file").alias("file_path"), F.col("k").cast("int").alias("line_count"), F.col("est_tokens").cast("int").alias("estimated_tokens"), "ts"))
    good = logs.strict(spark, _as_files(rows, scratch_path(spark, "denied"), "good"))
    bad = logs.strict(spark, _as_files(rows.unionByName(spark.range(1).select(F.lit("{broken").alias("value"))), scratch_path(spark, "denied"), "bad"))
    return good.unionByName(bad)


@query("e01_append_stream", f"{HOOKS} SELECT * FROM h")
def e01(spark, sf):
    """Events as a stream of JSON lines that goes to a folder for each day."""
    at = scratch_path(spark, "append")
    logs.stream_log(spark, _as_files(_json(_hooks(spark, sf)), f"{at}/in", "hook-events"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return logs.events(spark, f"{at}/out").select(*_KEPT)


@query("s19_agents", "SELECT 'agent-' || s_suppkey AS name, 'find ' || s_suppkey AS quoted, 'when,asked,find,agent' || s_suppkey || ',searches' AS keywords, 'writing,tests' AS negative FROM supplier WHERE s_suppkey % 5 <> 0")
def s19(spark, sf):
    """An agent's definition for each supplier, a file each; one in five has no front matter."""
    k = F.col("s_suppkey").cast("string")
    head = F.concat(F.lit("---\nname: agent-"), k, F.lit('\ndescription: Use when asked to "find '), k, F.lit('". Agent'), k, F.lit(" searches. Not for writing tests\n---\nbody"))
    d = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 5 == 0, "no front matter").otherwise(head).alias("value"), "s_suppkey")
    at = scratch_path(spark, "agents")
    logs.file_each(d.select("value"), at)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return logs.agents(spark, at).select("name", joined("quoted"), joined("keywords"), joined("negative"))


@query("s20_workflows", "SELECT 'w' || s_suppkey AS workflow_id, 'ship ' || s_suppkey AS goal, CAST(s_suppkey * 1000 AS BIGINT) AS budget_tokens, CAST(row_number() OVER (ORDER BY s_suppkey % 7 DESC, 'w' || s_suppkey) AS INTEGER) AS ord FROM supplier")
def s20(spark, sf):
    """A workflow's envelope for each supplier, a document of several lines in a file each; the newest come first."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{\n "workflow_id": "w'), k, F.lit('",\n "goal": "ship '), k, F.lit('",\n "started_at": "2025-01-0'), (F.col("s_suppkey") % 7 + 1).cast("string"), F.lit('",\n "budget_tokens": '), (F.col("s_suppkey") * 1000).cast("string"), F.lit("\n}"))
    at = scratch_path(spark, "workflows")
    logs.file_each(table(spark, sf, "supplier").select(text.alias("value")), at)
    from pyspark.sql.window import Window

    d = logs.workflows(spark, at)
    return d.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("started_at"), "workflow_id"))).select("workflow_id", "goal", "budget_tokens", "ord")


MANIFESTS = [("a/package.json", '{"name": "n§"}'), ("a/pyproject.toml", '[project]\nname = "py§"'), ("go.mod", "module m/x§\n"), ("b/readme", ""), ("Cargo.toml", '[package]\nname = "r"')]
query("s21_manifests", per_customer_sql("SELECT * FROM (VALUES ('a', 'Node', 'n§'), ('a', 'Python', 'py§')) t(project, language, name)", "project", "", "name") + " UNION ALL SELECT 'c' || c_custkey, unnest(['Go', 'Rust']), unnest(['m/x' || c_custkey, 'r']) FROM customer")(lambda s, d: logs.manifests(per_customer(s, d, MANIFESTS, "path string, content string", ("path",))))

query("k04_newest_snapshots", f"{EVENTS} SELECT session_id, ts, event_id FROM hook_events QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC) <= 10")(lambda s, d: logs.keep_newest(view(s, d, "hook_events").select("session_id", "ts", "event_id")))
query("t24_snapshot_text", """SELECT o_orderkey AS id, '**Goal:** g' || o_orderkey || CASE WHEN o_orderkey % 3 > 0 THEN chr(10) || '**Decisions:** ' || array_to_string(list_transform(range(1, o_orderkey % 3 + 1), lambda i: 'd' || i), '; ') ELSE '' END
|| CASE WHEN o_orderkey % 2 = 1 THEN chr(10) || '**Blocked:** ' || o_orderstatus ELSE '' END || chr(10) || '**Next:** n' AS text FROM orders""")(lambda s, d: _snapshots(s, d))


def _snapshots(spark, sf):
    k = F.col("o_orderkey")
    decided = F.transform(F.filter(F.sequence(F.lit(0), k % 3), lambda i: i > 0), lambda i: F.concat(F.lit("d"), i.cast("string")))
    note = logs.snapshot_text(F.concat(F.lit("g"), k.cast("string")), decided, F.array().cast("array<string>"), F.when(k % 2 == 1, F.col("o_orderstatus")), F.lit("n"))
    return table(spark, sf, "orders").select(k.alias("id"), note.alias("text"))


query("f10_intents", f"{CALLS} SELECT event_id, {INTENT_SQL} AS intent FROM tool_calls")(lambda s, d: view(s, d, "tool_calls").select("event_id", telemetry.intent(F.col("tool")).alias("intent")))
query("f11_symbol_alone", r"""SELECT o_orderkey AS id, o_orderkey % 4 IN (0, 3) AS alone FROM orders""")(lambda s, d: _alone(s, d))


def _alone(spark, sf):
    """A name with signs that patterns know, alone, as part of another, and as what the signs would find."""
    text = F.get(F.array(F.lit("call $a.b(x)"), F.lit("call my_$a.bc"), F.lit("call $axb()"), F.lit("$a.b")), (F.col("o_orderkey") % 4).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), graph.boundary(text, "$a.b").alias("alone"))


@query("e03_debounce_stream", """WITH f AS (SELECT event_id % 97 AS file, ts, event_id FROM events), d AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 3600 SECOND THEN 0 ELSE 1 END AS s FROM f WINDOW w AS (PARTITION BY file ORDER BY ts, event_id)),
g AS (SELECT *, sum(s) OVER (PARTITION BY file ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM d)
SELECT 'f' || file AS file, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS n FROM g GROUP BY file, g.n""")
def e03_stream(spark, sf):
    """Bursts as a stream: a last event far behind all others lets the watermark pass them, and then ends unseen."""
    from lodestrata.streaming.ttl import run_to_end

    at = scratch_path(spark, "bursts")
    e = table(spark, sf, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 97).cast("string")).alias("file"), F.col("ts").cast("timestamp").alias("at"))
    e.write.parquet(f"{at}/in")
    for last in (False, True):
        if last:
            e.agg((F.max("at") + F.expr("interval 30 days")).alias("at")).select(F.lit("end").alias("file"), "at").where("at is not null").write.mode("append").parquet(f"{at}/in")
        run_to_end(state.debounced(spark.readStream.schema(e.schema).parquet(f"{at}/in"), gap="3600 seconds"), f"{at}/out", f"{at}/checkpoint", 8)
    return spark.read.schema("file string, start timestamp, end timestamp, n long").parquet(f"{at}/out").select("file", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("k05_fingerprints", "SELECT CAST(1 AS BIGINT) AS version, 'type ' || s_suppkey AS \"projectType\", CAST(s_suppkey AS BIGINT) AS \"moduleCount\" FROM supplier WHERE s_suppkey % 5 <> 0")
def k05(spark, sf):
    """A fingerprint for each supplier, one in five without a version; read now they are good, a day and an hour later they are not."""
    at, k = scratch_path(spark, "fingerprints"), F.col("s_suppkey")
    d = table(spark, sf, "supplier").select(k.alias("project"), F.when(k % 5 != 0, 1).cast("long").alias("version"), F.lit("2025-01-01").alias("generatedAt"), F.concat(F.lit("type "), k.cast("string")).alias("projectType"), F.array(F.lit("x")).alias("frameworks"), k.cast("long").alias("moduleCount"), F.lit(3).cast("long").alias("sourceFileCount"))
    logs.save_fingerprints(d, at)
    late = logs.fingerprints(spark, f"{at}/*", F.current_timestamp() + F.expr("interval 25 hours"))
    return logs.fingerprints(spark, f"{at}/*").unionByName(late).select("version", "projectType", "moduleCount")
