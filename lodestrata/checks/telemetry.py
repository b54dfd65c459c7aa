"""Queries of the telemetry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.operators import telemetry as t
from lodestrata.sources.adapters import duck, view

CALLS, EVENTS = duck("tool_calls"), duck("hook_events")
PCT = "CAST(CASE WHEN sum(tokens_would_be) > 0 THEN floor((1 - sum(tokens_returned) / sum(tokens_would_be)) * 100 + 0.5) ELSE 0 END AS BIGINT)"
SAVED = "CAST(sum(greatest(0, tokens_would_be - tokens_returned)) AS BIGINT)"
SUMS = "CAST(sum(tokens_returned) AS BIGINT) AS returned, CAST(sum(tokens_would_be) AS BIGINT) AS would_be"
BUDGET, NOW = 4000, "(SELECT max(ts) FROM hook_events)"
BURN = f"floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, sum(saved_tokens) / {BUDGET})) * 10000 + 0.5) / 10000"
MISS = "(matched_agent <> '' AND matched_agent <> subagent_type)"
PROFILES = {"nav": ["find_usages", "outline", "read_range", "read_symbol", "smart_read"], "edit": ["code_audit", "find_usages", "outline", "read_for_edit", "read_range", "read_symbol", "smart_diff", "smart_read", "test_summary"]}
WORKFLOWS = [(f"wf{i}", 100_000 * (i + 1) if i % 4 else 0) for i in range(11)]
INTENT_SQL = "CASE " + " ".join(f"WHEN tool = '{k}' THEN '{v}'" for k, v in t.INTENTS.items()) + " ELSE 'read' END"


def _calls(spark, sf):
    return view(spark, sf, "tool_calls")


def _events(spark, sf):
    return view(spark, sf, "hook_events")


def _on(source, op, *args, **kw):
    return lambda spark, sf: op(source(spark, sf), *args, **kw)


query("d01_session_totals", f"{CALLS} SELECT count(*) AS n_calls, {SUMS}, CAST(sum(tokens_would_be) - sum(tokens_returned) AS BIGINT) AS saved, {PCT} AS saved_pct FROM tool_calls")(_on(_calls, t.session_totals))
query("d02_by_tool", f"{CALLS} SELECT tool, count(*) AS n_calls, {SUMS}, {SAVED} AS saved, {PCT} AS reduction_pct FROM tool_calls GROUP BY tool")(_on(_calls, t.by_tool))
query("d03_by_file", f"{CALLS} SELECT path, {SAVED} AS saved FROM tool_calls WHERE path IS NOT NULL AND path <> '' GROUP BY path ORDER BY saved DESC, path LIMIT 3")(_on(_calls, t.by_file))
query("d04_cache_hits", f"""{CALLS}
SELECT count(*) AS n_calls, count(*) FILTER (session_cache_hit) AS hits, CAST(coalesce(sum(greatest(0, tokens_would_be - tokens_returned)) FILTER (session_cache_hit), 0) AS BIGINT) AS saved_by_hits,
       CAST(floor(count(*) FILTER (session_cache_hit) / count(*) * 100 + 0.5) AS BIGINT) AS hit_pct FROM tool_calls""")(_on(_calls, t.cache_hits))
query("d05_low_value_tools", f"""{CALLS}, g AS (SELECT tool, count(*) AS n_calls, {SUMS}, {SAVED} AS saved, {PCT} AS reduction_pct FROM tool_calls GROUP BY tool)
SELECT * FROM g WHERE reduction_pct < 51 ORDER BY saved DESC, tool LIMIT 5""")(_on(_calls, t.low_value_tools, 51))
query("d06_by_category", f"{CALLS} SELECT coalesce(savings_category, 'none') AS category, count(*) AS n_calls, {SAVED} AS saved FROM tool_calls GROUP BY 1")(_on(_calls, t.by_category))
query("d07_by_intent", f"{CALLS} SELECT {INTENT_SQL} AS intent, count(*) AS n_calls, CAST(sum(tokens_returned) AS BIGINT) AS returned FROM tool_calls GROUP BY 1")(_on(_calls, t.by_intent))
query("d08_decision_insights", f"""{CALLS}
SELECT count(*) FILTER (savings_category = 'dedup') AS in_context, count(*) AS n_calls, CAST(sum(tokens_would_be) AS BIGINT) AS estimated, CAST(sum(tokens_returned) AS BIGINT) AS actual,
       count(*) FILTER (tokens_returned > tokens_would_be) AS missed, CAST(floor(count(*) FILTER (savings_category = 'dedup') / count(*) * 100 + 0.5) AS BIGINT) AS in_context_pct FROM tool_calls""")(_on(_calls, t.decision_insights))
query("d09_denied_reads", f"""{EVENTS} SELECT file, count(*) AS n, CAST(sum(est_tokens) AS BIGINT) AS tokens FROM hook_events
WHERE event = 'denied' AND ts >= 1704067200000 GROUP BY file ORDER BY tokens DESC, file LIMIT 5""")(_on(_events, t.denied_reads, 1_704_067_200_000))
query("d10_tool_audit", f"""{CALLS}
SELECT tool, count(*) AS n_calls, {SUMS}, count(*) FILTER (coalesce(savings_category, 'none') = 'none') AS none_calls, count(*) FILTER (session_cache_hit) AS cache_hit_calls,
       CAST(greatest(0, sum(tokens_would_be) - sum(tokens_returned)) AS BIGINT) AS saved, {PCT} AS reduction_pct, count(*) >= 5 AND {PCT} < 20 AS low_value
FROM tool_calls GROUP BY tool""")(_on(_calls, t.tool_audit))
query("d11_session_stats", f"{EVENTS} SELECT session_id, CAST(sum(saved_tokens) AS BIGINT) AS saved, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM hook_events WHERE session_id <> '' GROUP BY session_id")(_on(_events, t.session_stats))
query("d12_budget_burn", f"""{EVENTS}, s AS (SELECT session_id, CAST(sum(saved_tokens) AS BIGINT) AS saved, {BURN} AS burn, CAST(floor(sum(saved_tokens) / count(*) + 0.5) AS BIGINT) AS avg_saved FROM hook_events GROUP BY session_id)
SELECT *, CASE WHEN avg_saved > 0 THEN CAST(floor(greatest(0, {BUDGET} - saved) / avg_saved) AS BIGINT) END AS events_left FROM s""")(_on(_events, t.budget_burn, BUDGET))


@query("d13_effective_threshold", f"""{EVENTS}, s AS (SELECT session_id, {BURN} AS burn, count(*) * 2 AS base FROM hook_events GROUP BY session_id)
SELECT session_id, CAST(CASE WHEN burn < 0.3 THEN base WHEN burn < 0.6 THEN greatest(50, floor(base * 0.75 + 0.5)) WHEN burn < 0.8 THEN greatest(50, floor(base * 0.5 + 0.5))
       ELSE greatest(50, floor(base * 0.3::DOUBLE + 0.5)) END AS BIGINT) AS threshold FROM s""")
def d13(spark, sf):
    s = t.session_stats(_events(spark, sf))
    return s.select("session_id", t.effective_threshold(t.burn_fraction(F.col("saved"), F.lit(BUDGET)), F.col("n_events") * 2).alias("threshold"))


query("d14_stats_by_file", f"{EVENTS} SELECT file, count(*) AS n, CAST(sum(saved_tokens) AS BIGINT) AS saved FROM hook_events WHERE file <> '' GROUP BY file ORDER BY saved DESC, file LIMIT 10")(_on(_events, t.stats_by_file))
query("d14_stats_by_agent", f"{EVENTS} SELECT coalesce(agent_type, 'main') AS agent, count(*) AS n, CAST(sum(saved_tokens) AS BIGINT) AS saved FROM hook_events GROUP BY 1")(_on(_events, t.stats_by_agent))
query("d14a_latest_session", f"{EVENTS} SELECT session_id FROM hook_events ORDER BY ts DESC, event_id LIMIT 1")(_on(_events, t.latest_session))
query("d14b_task_misses", f"""{EVENTS} SELECT subagent_type, count(*) AS picks, count(*) FILTER (WHERE {MISS}) AS misses,
CAST(floor(count(*) FILTER (WHERE {MISS}) / count(*) * 100 + 0.5) AS BIGINT) AS miss_pct FROM hook_events WHERE event = 'task' GROUP BY subagent_type""")(_on(_events, t.task_misses))
query("d14b_miss_pairs", f"{EVENTS} SELECT subagent_type, matched_agent, count(*) AS n FROM hook_events WHERE event = 'task' AND {MISS} GROUP BY ALL ORDER BY n DESC, subagent_type, matched_agent LIMIT 10")(_on(_events, t.miss_pairs))
query("d14c_workflow_rollup", f"{EVENTS} SELECT workflow_id, CAST(sum(est_tokens) AS BIGINT) AS used, count(*) FILTER (event = 'task') AS tasks, count(*) FILTER (over_budget) AS over FROM hook_events WHERE workflow_id IS NOT NULL GROUP BY workflow_id")(_on(_events, t.workflow_rollup))


@query("d15_workflow_status", f"""{EVENTS}, w(workflow_id, budget) AS (VALUES {', '.join(f"('{a}', {b})" for a, b in WORKFLOWS)}),
u AS (SELECT workflow_id, sum(est_tokens) FILTER (event = 'task') AS used, count(*) FILTER (event = 'task') AS tasks, count(*) FILTER (over_budget) AS over FROM hook_events GROUP BY workflow_id)
SELECT workflow_id, CAST(budget AS BIGINT) AS budget, CAST(coalesce(used, 0) AS BIGINT) AS used, coalesce(tasks, 0) AS tasks, coalesce(over, 0) AS over,
       CASE WHEN budget > 0 THEN CAST(floor(coalesce(used, 0) / budget * 100 + 0.5) AS BIGINT) END AS pct,
       coalesce(CASE WHEN budget > 0 THEN floor(coalesce(used, 0) / budget * 100 + 0.5) END >= 90, false) AS near FROM w LEFT JOIN u USING (workflow_id)""")
def d15(spark, sf):
    return t.workflow_status(_events(spark, sf), spark.createDataFrame(WORKFLOWS, "workflow_id string, budget long"))


@query("d16_retention", duck("log_files") + """, n AS (SELECT max(mtime) AS now FROM log_files),
live AS (SELECT id, mtime, size FROM log_files, n WHERE mtime >= now - 400 * 86400000::BIGINT),
r AS (SELECT id, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY mtime, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS older FROM live)
SELECT id, 'cap' AS why FROM r WHERE total - older > 100000000 UNION ALL SELECT id, 'age' FROM log_files, n WHERE mtime < now - 400 * 86400000::BIGINT""")
def d16(spark, sf):
    f = view(spark, sf, "log_files")
    return t.retention(f, F.lit(f.agg(F.max("mtime")).first()[0]), days=400)


@query("d18_adoption_nudge", f"""{EVENTS}, r AS (SELECT * FROM hook_events WHERE event = 'task' AND ts >= {NOW} - 7 * 86400000::BIGINT)
SELECT count(*) AS n, count(*) FILTER (WHERE {MISS}) AS misses, count(*) >= 5 AND count(*) FILTER (WHERE {MISS}) >= 0.5 * count(*) AS nudge FROM r""")
def d18(spark, sf):
    e = _events(spark, sf)
    return t.adoption_nudge(e, F.lit(e.agg(F.max("ts")).first()[0]))


query("d19_over_budget", f"{CALLS} SELECT event_id, CAST(floor((tokens_returned / tokens_would_be - 1) * 10000 + 0.5) AS BIGINT) AS over_by_e4 FROM tool_calls WHERE tokens_would_be > 0 AND tokens_returned > tokens_would_be * 1.1::DOUBLE")(_on(_calls, t.over_budget))
query("d20_error_codes", f"{EVENTS} SELECT code, count(*) AS n FROM hook_events GROUP BY code ORDER BY n DESC, code LIMIT 10")(_on(_events, t.error_codes))
query("s13_error_tail", f"{EVENTS} SELECT event_id, ts, hook, code FROM hook_events WHERE code = 'code3' AND hook = 'hook1' ORDER BY ts DESC, event_id DESC LIMIT 20")(_on(_events, t.error_tail, 20, "code3", "hook1"))
query("d21_profile_advice", f"""{CALLS}, g AS (SELECT session_id, list_sort(list(DISTINCT tool)) AS l, count(*) AS n_calls FROM tool_calls GROUP BY session_id)
SELECT session_id, array_to_string(l, ',') AS tools, 'full' AS profile, CASE WHEN n_calls < 20 THEN 'low' ELSE 'high' END AS confidence,
       CASE {' '.join(f"WHEN list_has_all({p}, l) THEN '{n}'" for n, p in PROFILES.items())} ELSE 'mixed' END AS reason FROM g""")(_on(_calls, t.profile_advice, PROFILES))


@query("d22_status_line", duck("hook_events", "tool_calls") + """
SELECT session_id, CAST(sum(s) AS BIGINT) AS saved FROM (SELECT session_id, saved_tokens AS s FROM hook_events UNION ALL SELECT session_id, greatest(0, tokens_would_be - tokens_returned) FROM tool_calls) GROUP BY session_id""")
def d22(spark, sf):
    return t.status_line(_events(spark, sf), _calls(spark, sf))


@query("d23_what_if", duck("files") + """, f AS (SELECT path, length(content)::BIGINT AS tokens FROM files), x AS (SELECT * FROM f ORDER BY path LIMIT 20)
SELECT CAST(sum(tokens) AS BIGINT) AS first_tokens, (SELECT count(*) FROM f) AS n_files, CAST(floor(avg(tokens) * (SELECT count(*) FROM f) + 0.5) AS BIGINT) AS estimate FROM x""")
def d23(spark, sf):
    return t.what_if(view(spark, sf, "files").select("path", F.length("content").cast("long").alias("tokens")))


@query("d25_overlapping_ranges", duck("symbols") + """, s AS (SELECT path, CAST(sum(end_line - start_line + 1) AS BIGINT) AS covered, CAST(max(end_line) AS BIGINT) AS n_lines FROM symbols GROUP BY path)
SELECT path, covered, n_lines FROM s WHERE covered > 0.5 * n_lines""")
def d25(spark, sf):
    s = view(spark, sf, "symbols")
    return t.overlapping_ranges(s, s.groupBy("path").agg(F.max("end_line").cast("long").alias("n_lines")), 0.5)
