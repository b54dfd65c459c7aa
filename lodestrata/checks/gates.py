"""Queries of the rule gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.operators import gates as g
from lodestrata.sources.adapters import duck, per_customer, per_customer_sql, table, view

query("f08_policy_advice", duck("tool_calls") + """, r AS (SELECT *, tool IN ('smart_read', 'smart_read_many') AS f, sum(CASE WHEN tool IN ('smart_read', 'smart_read_many') THEN 1 ELSE 0 END) OVER w AS fulls, count(*) OVER w AS n, sum(tokens_returned) OVER w AS total
FROM tool_calls WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), a AS (SELECT event_id, CASE WHEN f AND fulls >= 10 THEN 'full_reads' WHEN tokens_returned > 2000 THEN 'large' WHEN f AND tokens_returned > 500 THEN 'expensive' WHEN n % 15 = 0 THEN 'many_calls' WHEN total > 8000 AND n % 5 = 0 THEN 'many_tokens' END AS advice FROM r)
SELECT * FROM a WHERE advice IS NOT NULL""")(lambda s, d: g.policy_advice(view(s, d, "tool_calls")))


@query("f09_cheaper", """WITH c AS (SELECT event_id AS id, ['smart_read','read_symbol','smart_read_many','read_range','outline'][event_id % 5 + 1] AS tool, event_id % 2 = 0 AS in_context, event_id % 3 = 0 AS edited, event_id % 7 < 4 AS symbol_known, event_id % 400 AS n_lines, event_id % 130 AS asked FROM events),
p AS (SELECT *, CASE WHEN tool IN ('smart_read', 'read_symbol') AND in_context AND edited THEN 'read_diff' WHEN tool = 'smart_read' AND symbol_known AND n_lines > 50 THEN 'read_symbol' WHEN tool = 'smart_read_many' AND in_context THEN 'read_diff' WHEN tool = 'read_range' AND asked > 60 AND symbol_known THEN 'read_symbol' END AS plan FROM c)
SELECT id, plan, CASE WHEN plan IS NULL THEN NULL WHEN tool IN ('smart_read', 'read_symbol') AND in_context AND edited OR tool = 'smart_read_many' THEN greatest(20, floor(0.1::DOUBLE * n_lines + 0.5)::BIGINT) WHEN tool = 'smart_read' THEN floor(0.15::DOUBLE * n_lines + 0.5)::BIGINT ELSE floor(0.4::DOUBLE * asked + 0.5)::BIGINT END AS lines FROM p""")
def f09(spark, sf):
    e = F.col("event_id")
    tools = F.array(*map(F.lit, ["smart_read", "read_symbol", "smart_read_many", "read_range", "outline"]))
    c = table(spark, sf, "events").select(e.alias("id"), F.get(tools, (e % 5).cast("int")).alias("tool"), (e % 2 == 0).alias("in_context"), (e % 3 == 0).alias("edited"), (e % 7 < 4).alias("symbol_known"), (e % 400).alias("n_lines"), (e % 130).alias("asked"))
    return g.cheaper(c)


@query("p23_read_span", """SELECT event_id, CASE WHEN event_id % 5 = 0 AND event_id % 3 = 0 THEN event_id ELSE greatest(0, least(coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id % 300 END, 2000), event_id - coalesce(CASE WHEN event_id % 3 <> 0 THEN event_id % 700 END, 0))) END AS span FROM events""")
def p23(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", g.read_span(F.when(e % 5 != 0, e % 300), F.when(e % 3 != 0, e % 700), e).alias("span"))


query("p24_large_output", "SELECT doc_id, length(text) >= 8000 AS large FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", g.large_output(F.col("text")).alias("large")))
#: Patterns and commands with what is decided on each; searches in advisory mode are only advised on.
SEARCHES = [
    ("TODO|FIXME", "deny", "advise"), ("getUser", "deny", "deny"), ("my_name", "deny", "deny"), ("foo.*bar", "deny", "allow"), ("getUser", "advisory", "allow"), ("abc", "deny", "allow"), ("MAXLEN", "deny", "deny"),
    ("plain", "deny", "allow"), ("(todo | hack)", "advisory", "advise"), ("OPTIMIZE|refactor", "deny", "advise"), ("WARN", "deny", "deny"), ("TODO|WARNING", "deny", "allow"), ("MAX2", "deny", "deny"), ("A1bc", "deny", "deny"),
    ("kebab-case", "deny", "deny"), ("12345", "deny", "allow"), ("two words", "deny", "allow"), ("User§", "deny", "deny"), ("XXX", "deny", "advise"), ("TODO|", "deny", "allow"),
]


def _listed(rows, names):
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"


@query("p19_search_gate", per_customer_sql(_listed([(i, g_) for i, (_, _, g_) in enumerate(SEARCHES)], "id, gate"), "", "id"))
def p19(spark, sf):
    d = per_customer(spark, sf, [(i, p, m) for i, (p, m, _) in enumerate(SEARCHES)], "id int, p string, m string", (), ("id",))
    return d.select("id", g.search_gate(F.col("p"), F.col("m")).alias("gate"))


COMMANDS = [
    ("grep -r foo src/", "deny"), ("grep -R bar .", "deny"), ("grep -r -m 20 foo src/", "allow"), ("grep foo src/file.ts", "allow"), ("cd x && grep -r a .", "deny"), ("grep foo -r .", "deny"),
    ("find / -name '*.ts'", "deny"), ("find ~ -type f", "deny"), ("find / -maxdepth 3 -name '*.conf'", "allow"), ("find src -name '*.ts'", "allow"),
    ("cat src/foo§.ts", "deny"), ("cat main.py", "deny"), ("cat README.md", "allow"), ("cat config.json", "allow"), ("cat src/foo.ts | head -20", "allow"), ("cat > /tmp/out.txt", "allow"), ("cat >> /var/log/app.log", "allow"),
    ("cat <<EOF\nrun x.sh\nEOF", "allow"), ("sed -n '1,500p' src/foo.ts", "deny"), ("sed -n 1,400p app/main.py", "deny"), ("sed -i 's/a/b/' src/foo.ts", "allow"), ("sed -i.bak 's/a/b/g' src/foo.ts", "allow"),
    ("cat src/foo.ts | sed -n '1,5p'", "allow"), ("sed 's/a/b/' src/foo.ts > out.ts", "allow"), ("sed -n '1,500p' README.md", "allow"), ("head -n 500 src/foo.ts", "deny"), ("head -500 src/foo.ts", "deny"),
    ("tail -n 400 app/main.py", "deny"), ("head -20 src/foo.ts", "allow"), ("head src/foo.ts", "allow"), ("tail -n 50 src/foo.ts", "allow"), ("head -c 5000 src/foo.ts", "allow"), ("head -n 500 README.md", "allow"),
    ("git log", "deny"), ("git log --oneline -5", "allow"), ("git log -n 20", "allow"), ("git log | head -20", "allow"), ("git log --oneline", "deny"), ("git commit -m 'about git log'", "allow"),
    ("git diff", "deny"), ("git diff --stat", "allow"), ("git diff src/a.ts", "allow"), ("git diff | cat", "deny"), ("bash -c \"cat src/foo.ts\"", "deny"), ("sh -c 'cat main.py'", "deny"), ("eval \"grep -r x .\"", "deny"),
    ("for f in *.ts; do cat $f.ts; done", "deny"), ("while true; do git log; done", "deny"), ("bash -c 'pytest'", "advise"), ("npm test", "advise"), ("npm run test:unit", "advise"), ("npx vitest run", "advise"), ("go test ./...", "advise"),
    ("cargo test", "advise"), ("npm run build", "allow"), ("ls", "allow"), ("", "allow"),
]


@query("p20_command_gate", per_customer_sql(_listed([(i, g_) for i, (_, g_) in enumerate(COMMANDS)], "id, gate"), "", "id"))
def p20(spark, sf):
    d = per_customer(spark, sf, [(i, c) for i, (c, _) in enumerate(COMMANDS)], "id int, c string", (), ("id",))
    return d.select("id", g.command_gate(F.col("c")).alias("gate"))


@query("p21_edit_gate", "SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 2 = 0 OR event_id % 5 = 0 OR event_id % 3 = 0 OR NOT event_id % 4 IN (0, 1, 2) THEN 'allow' WHEN event_id % 7 < 3 THEN 'deny' ELSE 'advise' END AS gate FROM events")
def p21(spark, sf):
    e = F.col("event_id")
    tool = F.get(F.array(*map(F.lit, ["Edit", "MultiEdit", "Write", "Read"])), (e % 4).cast("int"))
    return table(spark, sf, "events").select("event_id", g.edit_gate(tool, e % 2 != 0, e % 5 != 0, e % 11 == 0, e % 3 == 0, F.when(e % 7 < 3, "deny").otherwise("advisory")).alias("gate"))


query("p22_task_gate", duck("hook_events") + " SELECT event_id, CASE WHEN k % 9 = 0 OR NOT (matched_agent <> '' AND matched_agent <> subagent_type) THEN 'allow' WHEN k % 2 = 1 THEN 'deny' ELSE 'advise' END AS gate FROM hook_events")(lambda s, d: view(s, d, "hook_events").select("event_id", g.task_gate(F.col("k") % 9 == 0, F.col("matched_agent"), F.col("subagent_type"), F.when(F.col("k") % 2 == 1, "deny").otherwise("advisory")).alias("gate")))
query("p18_inside", "SELECT doc_id, doc_id * 7 % 24 <= doc_id % 20 AS ok FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", g.inside(F.concat(F.lit("/r/x/"), F.repeat(F.lit("a/./"), (F.col("doc_id") % 20).cast("int")), F.repeat(F.lit("..//"), (F.col("doc_id") * 7 % 24).cast("int")), F.lit("etc")), "/r/x").alias("ok")))
AGENTS = [("reviewer", ["review the diff"], ["review", "diff", "quality"], ["write"]), ("finder", ["find usages"], ["find", "usage", "search"], []), ("tester", [], ["test", "coverage"], ["review"])]
query("f19_agent_match", per_customer_sql("SELECT * FROM (VALUES (1, 'reviewer', 'high'), (2, 'finder', 'low'), (3, NULL, NULL), (4, 'tester', 'low'), (5, 'finder', 'low')) t(id, agent, level)", "", "id"))(lambda s, d: g.agent_scores(per_customer(s, d, [(1, "Please review the diff"), (2, "search it"), (3, "nothing"), (4, "more coverage"), (5, "find a test")], "id int, description string", (), ("id",)), s.createDataFrame(AGENTS, "name string, quoted array<string>, keywords array<string>, negative array<string>")))
