"""Queries of the whole answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.checks.structure import FILES, files as own_files
from lodestrata.checks.telemetry import BUDGET, BURN, CALLS, EVENTS, INTENT_SQL, SAVED
from lodestrata.functions import exprs as e
from lodestrata.operators import changes, notations as nt, structure as st, text, tools as t
from lodestrata.plans.spread import parts_of, spread
from lodestrata.sources.adapters import duck, per_customer, per_customer_sql, table, view

query("t13_session_report", f"""{CALLS} SELECT 'tool' AS section, tool AS key, count(*) AS n, {SAVED} AS value FROM tool_calls GROUP BY tool UNION ALL SELECT 'category', coalesce(savings_category, 'none'), count(*), {SAVED} FROM tool_calls GROUP BY 2
UNION ALL SELECT 'intent', {INTENT_SQL}, count(*), CAST(sum(tokens_returned) AS BIGINT) FROM tool_calls GROUP BY 2""")(lambda s, d: t.session_report(view(s, d, "tool_calls")))
query("t25_session_budget", f"""{EVENTS}, s AS (SELECT session_id, CAST(sum(saved_tokens) AS BIGINT) AS saved, {BURN} AS burn, CAST(floor(sum(saved_tokens) / count(*) + 0.5) AS BIGINT) AS avg_saved FROM hook_events GROUP BY session_id)
SELECT *, CASE WHEN avg_saved > 0 THEN CAST(floor(greatest(0, {BUDGET} - saved) / avg_saved) AS BIGINT) END AS events_left, CAST(CASE WHEN burn < 0.3 THEN 300 WHEN burn < 0.6 THEN 225 WHEN burn < 0.8 THEN 150 ELSE 90 END AS BIGINT) AS threshold FROM s""")(lambda s, d: t.session_budget(view(s, d, "hook_events"), BUDGET))
query("n07_edit_slice", duck("symbols") + " SELECT path, name, start_line, end_line, greatest(1, start_line - 5) AS lo, least(70, start_line + least(end_line - start_line + 1, 6) - 1 + 5) AS hi FROM symbols")(lambda s, d: t.edit_slice(view(s, d, "symbols"), F.lit(70), 5, 6))
query("n06_symbol_display", duck("files") + """, lines AS (SELECT path, path AS name, i AS line_no, l[i] AS text, len(l) AS n FROM (SELECT path, string_split(content, chr(10)) AS l FROM files) f, unnest(range(1, len(l) + 1)) r(i))
SELECT path, name, line_no, text FROM lines WHERE n <= 5 OR line_no <= 2 OR line_no > n - 2""")(lambda s, d: st.shown_lines(text.lines(view(s, d, "files")).withColumn("name", F.col("path")), 5, 2, 2))
query("t16_code_audit", "SELECT kind, n * count(*) AS n, n_files * count(*) AS n_files FROM (VALUES ('TODO', 2::BIGINT, 2::BIGINT), ('FIXME', 2, 2)) t(kind, n, n_files), customer GROUP BY kind, n, n_files")(lambda s, d: t.code_audit(text.lines(per_customer(s, d, [("a", "# TODO x\n# FIXME y\nz"), ("b", "FIXME\nTODO late")], "path string, content string", ("path",))), 1 << 30))
query("t12_directory_outline", per_customer_sql("SELECT * FROM (VALUES ('src', 3::BIGINT, 10::BIGINT), ('pkg', 2, 0)) t(dir, n_files, n_symbols)", "dir"))(lambda s, d: t.directory_outline(own_files(s, d), st.symbols(own_files(s, d))))
query("t19_diff_report", per_customer_sql("SELECT * FROM (VALUES ('src/user.ts', 2::BIGINT, 1::BIGINT, 'Id MODIFIED,area MODIFIED,run MODIFIED'), ('new.py', 1, 0, NULL)) t(path, added, removed, symbols)", "path"))(lambda s, d: _diff(s, d))


def _diff(spark, sf):
    raw = "diff --git a/c§/src/user.ts b/c§/src/user.ts\n--- a/src/user.ts\n+++ b/src/user.ts\n@@ -20,1 +20,2 @@\n-type Id = number;\n+type Id = string;\n+x\ndiff --git a/c§/new.py b/c§/new.py\nnew file mode 100644\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+x"
    n = table(spark, sf, "customer").count()
    d = spread(per_customer(spark, sf, [(1, raw)], "diff_id int, raw string", (), ("diff_id",)), "diff_id", rows=n).select("diff_id", F.posexplode(F.split("raw", "\n", -1)).alias("line_no", "text"))
    return t.diff_report(changes.parse_diff(d), st.symbols(own_files(spark, sf)), parts_of(n * len(FILES)))


query("t20_area", "SELECT * FROM (VALUES ('external', 'os'), ('external', 'pkg.db'), ('internal', './store'), ('external', 'path')) t(section, item)")(lambda s, d: t.area(own_files(s, d), "c1/src"))
query("f06_cache_key", """WITH a AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, event_type || ':' || left(sha256('{"k":' || k || ',"name":"a\\":\\"b","nest":{"k":[' || k || ',{"name":"é"}]},"x":' || CASE WHEN k % 2 = 0 THEN k // 2 || '' ELSE k // 2 || '.5' END || '}'), 16) AS key FROM a""")(lambda s, d: _keys(s, d))


def _keys(spark, sf):
    """Arguments with keys out of order, quotes in values, and keys inside that the top level lacks."""
    k = F.get_json_object("props", "$.k").cast("long")
    args = F.concat(F.lit('{"x": '), (k / 2).cast("string"), F.lit(', "nest": {"other": 1, "k": ['), k.cast("string"), F.lit('.0, {"z": 2, "name": "\\u00e9"}]}, "name": "a\\":\\"b", "k": '), k.cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", nt.cache_key(F.col("event_type"), args).alias("key"))


query("f23_snapshot_goal", per_customer_sql("SELECT * FROM (VALUES (1, 'ship it §'), (2, '')) t(id, goal)", "", "id", "goal"))(lambda s, d: per_customer(s, d, [(1, "x\n**Goal:** ship it §\n**Goal:** other"), (2, "none")], "id int, t string", (), ("id",)).select("id", e.snapshot_goal(F.col("t")).alias("goal")))
