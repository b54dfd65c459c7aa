"""Telemetry aggregations: savings, audits, budgets, retention.

Three ways to clamp savings are kept apart, as they give different figures: per call (by_tool, by_file,
by_category), after the sum (tool_audit), and not at all (session_totals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.exprs import js_round, saved_pct

DAY_MS = 86_400_000
#: Intent of each tool; every other tool is for reading.
INTENTS = {
    "read_for_edit": "edit",
    "smart_diff": "review", "smart_log": "review", "read_diff": "review",
    "project_overview": "explore", "explore_area": "explore", "outline": "explore", "session_analytics": "explore",
    "find_usages": "search", "related_files": "search",
    "code_audit": "analyze", "find_unused": "analyze", "module_info": "analyze",
    "test_summary": "debug",
}


def _saved() -> Column:
    """What a call saved; a call that returned more than a plain read saved nothing."""
    return F.greatest(F.lit(0), F.col("tokens_would_be") - F.col("tokens_returned"))


def session_totals(calls: DataFrame) -> DataFrame:
    g = calls.agg(F.count("*").alias("n_calls"), F.sum("tokens_returned").alias("returned"), F.sum("tokens_would_be").alias("would_be"))
    return g.withColumn("saved", F.col("would_be") - F.col("returned")).withColumn("saved_pct", saved_pct(F.col("returned"), F.col("would_be")))


def by_tool(calls: DataFrame) -> DataFrame:
    g = calls.groupBy("tool").agg(F.count("*").alias("n_calls"), F.sum("tokens_returned").alias("returned"), F.sum(_saved()).alias("saved"), F.sum("tokens_would_be").alias("would_be"))
    return g.withColumn("reduction_pct", saved_pct(F.col("returned"), F.col("would_be")))


def top(df: DataFrame, metric: str, tie: str, k: int) -> DataFrame:
    """The k rows of the highest metric, ties by a key: planned as TakeOrderedAndProject."""
    return df.orderBy(F.desc(metric), F.asc(tie)).limit(k)


def by_file(calls: DataFrame, k: int = 3) -> DataFrame:
    g = calls.where("path is not null and path <> ''").groupBy("path").agg(F.sum(_saved()).alias("saved"))
    return top(g, "saved", "path", k)


def cache_hits(calls: DataFrame) -> DataFrame:
    hit = F.coalesce(F.col("session_cache_hit"), F.lit(False))
    g = calls.agg(F.count("*").alias("n_calls"), F.count_if(hit).alias("hits"), F.coalesce(F.sum(F.when(hit, _saved())), F.lit(0)).alias("saved_by_hits"))
    return g.withColumn("hit_pct", F.when(F.col("n_calls") > 0, js_round(F.col("hits") / F.col("n_calls") * 100)).otherwise(F.lit(0).cast("long")))


def low_value_tools(calls: DataFrame, pct: int = 20, k: int = 5) -> DataFrame:
    return top(by_tool(calls).where(F.col("reduction_pct") < pct), "saved", "tool", k)


def by_category(calls: DataFrame) -> DataFrame:
    return calls.groupBy(F.coalesce("savings_category", F.lit("none")).alias("category")).agg(F.count("*").alias("n_calls"), F.sum(_saved()).alias("saved"))


def intent(tool: Column) -> Column:
    """What a tool is used for. The map is a literal in the plan, not a join."""
    m = F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv])
    return F.coalesce(F.try_element_at(m, tool), F.lit("read"))


def by_intent(calls: DataFrame) -> DataFrame:
    return calls.groupBy(intent(F.col("tool")).alias("intent")).agg(F.count("*").alias("n_calls"), F.sum("tokens_returned").alias("returned"))


def decision_insights(calls: DataFrame) -> DataFrame:
    """Estimates against outcome: share answered from context, and calls that returned more than a plain read."""
    g = calls.agg(
        F.count_if(F.col("savings_category") == "dedup").alias("in_context"),
        F.count("*").alias("n_calls"),
        F.sum("tokens_would_be").alias("estimated"),
        F.sum("tokens_returned").alias("actual"),
        F.count_if(F.col("tokens_returned") > F.col("tokens_would_be")).alias("missed"),
    )
    return g.withColumn("in_context_pct", js_round(F.col("in_context") / F.col("n_calls") * 100))


def denied_reads(events: DataFrame, since: int, k: int = 5) -> DataFrame:
    g = events.where((F.col("event") == "denied") & (F.col("ts") >= since)).groupBy("file").agg(F.count("*").alias("n"), F.sum("est_tokens").alias("tokens"))
    return top(g, "tokens", "file", k)


def tool_audit(calls: DataFrame, min_count: int = 5, low_pct: int = 20) -> DataFrame:
    """Per tool: calls, tokens, savings clamped after the sum, and whether the tool saves little."""
    g = calls.groupBy("tool").agg(
        F.count("*").alias("n_calls"),
        F.sum("tokens_returned").alias("returned"),
        F.sum("tokens_would_be").alias("would_be"),
        F.count_if(F.coalesce("savings_category", F.lit("none")) == "none").alias("none_calls"),
        F.count_if(F.coalesce("session_cache_hit", F.lit(False))).alias("cache_hit_calls"),
    )
    g = g.withColumn("saved", F.greatest(F.lit(0), F.col("would_be") - F.col("returned")))
    g = g.withColumn("reduction_pct", saved_pct(F.col("returned"), F.col("would_be")))
    return g.withColumn("low_value", (F.col("n_calls") >= min_count) & (F.col("reduction_pct") < low_pct))


def session_stats(events: DataFrame) -> DataFrame:
    return events.where("session_id <> ''").groupBy("session_id").agg(F.sum("saved_tokens").alias("saved"), F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def burn_fraction(saved: Column, budget: Column) -> Column:
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), saved / budget)) * 10000 + 0.5) / 10000


def budget_burn(events: DataFrame, budget: int) -> DataFrame:
    """Burn to four places, average saving per event, and how many more events the budget holds."""
    s = session_stats(events)
    s = s.withColumn("burn", burn_fraction(F.col("saved"), F.lit(budget)))
    s = s.withColumn("avg_saved", js_round(F.col("saved") / F.col("n_events")))
    left = F.greatest(F.lit(0), budget - F.col("saved"))
    return s.withColumn("events_left", F.when(F.col("avg_saved") > 0, F.floor(left / F.col("avg_saved")).cast("long"))).select("session_id", "saved", "burn", "avg_saved", "events_left")


def effective_threshold(burn: Column, base: Column, floor: int = 50) -> Column:
    """The base, tightened in steps as the budget burns; the floor holds only where it was tightened."""
    rate = F.when(burn < 0.3, 1.0).when(burn < 0.6, 0.75).when(burn < 0.8, 0.5).otherwise(0.3)
    return F.when(rate == 1.0, base).otherwise(F.greatest(F.lit(floor), js_round(base * rate))).cast("long")


def stats_by_file(events: DataFrame, k: int = 10) -> DataFrame:
    return top(events.where("file <> ''").groupBy("file").agg(F.count("*").alias("n"), F.sum("saved_tokens").alias("saved")), "saved", "file", k)


def stats_by_agent(events: DataFrame) -> DataFrame:
    return events.groupBy(F.coalesce("agent_type", F.lit("main")).alias("agent")).agg(F.count("*").alias("n"), F.sum("saved_tokens").alias("saved"))


def latest_session(events: DataFrame) -> DataFrame:
    """Of events of one time the first decides."""
    return events.agg(F.max_by("session_id", F.struct(F.col("ts"), -F.col("event_id"))).alias("session_id"))


def _miss() -> Column:
    return F.coalesce((F.col("matched_agent") != "") & (F.col("matched_agent") != F.col("subagent_type")), F.lit(False))


def task_misses(events: DataFrame) -> DataFrame:
    g = events.where("event = 'task'").groupBy("subagent_type").agg(F.count("*").alias("picks"), F.count_if(_miss()).alias("misses"))
    return g.withColumn("miss_pct", js_round(F.col("misses") / F.col("picks") * 100))


def miss_pairs(events: DataFrame, k: int = 10) -> DataFrame:
    g = events.where("event = 'task'").where(_miss()).groupBy("subagent_type", "matched_agent").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "subagent_type", "matched_agent").limit(k)


def workflow_rollup(events: DataFrame) -> DataFrame:
    return events.where("workflow_id is not null").groupBy("workflow_id").agg(F.sum("est_tokens").alias("used"), F.count_if(F.col("event") == "task").alias("tasks"), F.count_if(F.col("over_budget")).alias("over"))


def workflow_status(events: DataFrame, workflows: DataFrame, near: int = 90) -> DataFrame:
    """Envelopes with what their events used; the envelopes are few, the events are summed first."""
    used = events.groupBy("workflow_id").agg(F.sum(F.when(F.col("event") == "task", F.col("est_tokens"))).alias("used"), F.count_if(F.col("event") == "task").alias("tasks"), F.count_if(F.col("over_budget")).alias("over"))
    w = workflows.join(used, "workflow_id", "left").select("workflow_id", "budget", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("used", "tasks", "over")])
    w = w.withColumn("pct", F.when(F.col("budget") > 0, js_round(F.col("used") / F.col("budget") * 100)))
    return w.withColumn("near", F.coalesce(F.col("pct") >= near, F.lit(False)))


def retention(files: DataFrame, now: Column, days: int = 30, cap: int = 100_000_000) -> DataFrame:
    """Files to delete: the too old, then the oldest of the rest while the rest is over the cap.

    The running sum goes over days first and inside a day then, so that no task holds all files.
    """
    f = files.withColumn("expired", F.col("mtime") < now - days * DAY_MS).withColumn("day", F.floor(F.col("mtime") / DAY_MS))
    live = f.where("not expired")
    per = live.groupBy("day").agg(F.sum("size").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("day", before.alias("before"), F.sum("s").over(Window.partitionBy()).alias("total"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("day").orderBy("mtime", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = live.withColumn("older", inside).join(per, "day").where(F.col("total") - F.col("before") - F.col("older") > cap).select("id", F.lit("cap").alias("why"))
    return f.where("expired").select("id", F.lit("age").alias("why")).unionByName(cut)


def adoption_nudge(events: DataFrame, now: Column, days: int = 7, least: int = 5) -> DataFrame:
    """Whether recent tasks often picked another agent than the matching one."""
    t = events.where(F.col("event") == "task").where(F.col("ts") >= now - days * DAY_MS)
    g = t.agg(F.count("*").alias("n"), F.count_if(_miss()).alias("misses"))
    return g.withColumn("nudge", (F.col("n") >= least) & (F.col("misses") >= 0.5 * F.col("n")))


def over_budget(calls: DataFrame, slack: float = 1.1) -> DataFrame:
    """Calls that returned over slack times their budget, and by which ratio to four places."""
    b, a = F.col("tokens_would_be"), F.col("tokens_returned")
    return calls.where((b > 0) & (a > b * slack)).select("event_id", F.floor((a / b - 1) * 10000 + 0.5).cast("long").alias("over_by_e4"))


def error_codes(errors: DataFrame, k: int = 10) -> DataFrame:
    return top(errors.groupBy("code").agg(F.count("*").alias("n")), "n", "code", k)


def error_tail(errors: DataFrame, n: int, code: str | None = None, hook: str | None = None) -> DataFrame:
    for c, v in (("code", code), ("hook", hook)):
        if v is not None:
            errors = errors.where(F.col(c) == v)
    return errors.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).select("event_id", "ts", "hook", "code")


def profile_advice(calls: DataFrame, profiles: dict[str, list[str]], least: int = 20) -> DataFrame:
    """Per session: the narrowest profile that holds all its tools is the reason; the advice is always the full one."""
    g = calls.groupBy("session_id").agg(F.array_sort(F.collect_set("tool")).alias("t"), F.count("*").alias("n_calls"))
    reason = F.lit("mixed")
    for name, tools in reversed(profiles.items()):
        reason = F.when(F.size(F.array_except("t", F.array(*map(F.lit, tools)))) == 0, F.lit(name)).otherwise(reason)
    return g.select("session_id", F.array_join("t", ",").alias("tools"), F.lit("full").alias("profile"), F.when(F.col("n_calls") < least, "low").otherwise("high").alias("confidence"), reason.alias("reason"))


def status_line(events: DataFrame, calls: DataFrame) -> DataFrame:
    """Savings per session from both logs: events as they are, calls clamped each."""
    one = events.groupBy("session_id").agg(F.sum("saved_tokens").alias("s")).unionByName(calls.groupBy("session_id").agg(F.sum(_saved()).alias("s")))
    return one.groupBy("session_id").agg(F.sum("s").alias("saved"))


def what_if(files: DataFrame, k: int = 20) -> DataFrame:
    """Tokens of the first k files by path, and the mean times their number as an estimate of all."""
    n = files.agg(F.count("*").alias("n_files"))
    first = files.orderBy("path").limit(k).agg(F.sum("tokens").alias("first_tokens"), F.avg("tokens").alias("m"))
    return first.crossJoin(n).select("first_tokens", "n_files", js_round(F.col("m") * F.col("n_files")).alias("estimate"))


def overlapping_ranges(symbols: DataFrame, lines: DataFrame, factor: float = 1.5) -> DataFrame:
    """Files whose top-level symbols add up to far more lines than they have."""
    s = symbols.groupBy("path").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("covered"))
    return s.join(lines, "path").where(F.col("covered") > factor * F.col("n_lines")).select("path", "covered", "n_lines")
