"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.functions import exprs as e
from lodestrata.sources.adapters import per_customer, per_customer_sql, table


def _v(name, sql, rows, schema, **cols):
    """A query over rows that each customer has, whose expected values stand in the SQL; § is the customer's key."""
    texts = {"base", "dir", "test", "source", "class"} & set(cols)
    query(name, per_customer_sql(sql, "", "id", ", ".join(sorted(texts))))(lambda s, d: per_customer(s, d, rows, schema, (), ("id",)).select("id", *[c().alias(n) for n, c in cols.items()]))


query("f02_saved_pct", "SELECT event_id, CAST(CASE WHEN event_id % 7 > 0 THEN floor((1 - floor(value) / (event_id % 7)) * 100 + 0.5) ELSE 0 END AS BIGINT) AS pct FROM events")(lambda s, d: table(s, d, "events").select("event_id", e.saved_pct(F.floor("value"), F.col("event_id") % 7).alias("pct")))
query("f03_js_round", "SELECT event_id, CAST(floor((event_id - 5000) / 2 + 0.5) AS BIGINT) AS r FROM events")(lambda s, d: table(s, d, "events").select("event_id", e.js_round((F.col("event_id") - 5000) / 2).alias("r")))
query("f04_keeps_whole", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity >= 0.7::DOUBLE * l_linenumber * 10 AND (CASE WHEN l_returnflag = 'R' THEN 30 END IS NULL OR l_linenumber * 10 <= 30) AS whole FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", e.keeps_whole(F.col("l_quantity"), F.col("l_linenumber") * 10, F.when(F.col("l_returnflag") == "R", 30)).alias("whole")))
_v("f05_savings_category", "SELECT * FROM (VALUES (1, 'dedup'), (2, 'dedup'), (3, 'none'), (4, 'compression'), (5, 'none'), (6, 'compression')) t(id, category)", [(1, "REMINDER: seen"), (2, "DEDUP: x"), (3, "a file returned in full, below threshold"), (4, "outline"), (5, "returned in full, outline not smaller"), (6, "returned in full")], "id int, t string", category=lambda: e.savings_category(F.col("t")))
_v("f07_confidence", "SELECT * FROM (VALUES (1, 'high', 8), (2, 'low', -2), (3, 'medium', 2), (4, 'low', 0)) t(id, level, score)", [(1, True, True, None, None, True, True, False, 0, None), (2, False, None, None, None, None, None, None, 9, True), (3, None, True, None, None, None, None, None, None, None), (4, None, None, None, None, True, None, True, 1, None)], "id int, a boolean, b boolean, c boolean, d boolean, e boolean, f boolean, g boolean, h int, i boolean", level=lambda: e.confidence(e.confidence_score(*map(F.col, "abcdefghi"))), score=lambda: e.confidence_score(*map(F.col, "abcdefghi")))
query(
    "f12_duration",
    """SELECT o_orderkey AS id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'm ' || s % 60 || 's' ELSE s // 3600 || 'h ' || (s // 60) % 60 || 'm' END AS d
FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (o_orderkey % 60) // 1000 AS s FROM orders)""",
)(lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").alias("id"), e.duration(F.floor("o_totalprice") * (F.col("o_orderkey") % 60)).alias("d")))
query(
    "f12_short_tokens",
    """SELECT o_orderkey AS id, CASE WHEN m >= 1000000 THEN (m + 50000) // 1000000 || '.' || ((m + 50000) // 100000) % 10 || 'M' WHEN m >= 1000 THEN (m + 50) // 1000 || '.' || ((m + 50) // 100) % 10 || 'k' ELSE m::VARCHAR END AS s,
CASE WHEN m >= 1000000 THEN (m + 50000) // 1000000 || '.' || ((m + 50000) // 100000) % 10 || 'M' WHEN m >= 1000 THEN (m + 500) // 1000 || 'k' ELSE m::VARCHAR END AS whole
FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (o_orderkey % 5) AS m FROM orders)""",
)(lambda s, d: _short(s, d))
_v("f12_formats", "SELECT * FROM (VALUES (1, '1m 23s', '83.0k', '83k'), (2, '12s', '12.0k', '12k'), (3, '1h 6m', '4.0M', '4.0M'), (4, '1s', '2.0k', '2k'), (5, '0s', '999', '999')) t(id, d, audit, workflow)", [(1, 83_000), (2, 12_000), (3, 4_000_000), (4, 1_999), (5, 999)], "id int, n long", d=lambda: e.duration(F.col("n")), audit=lambda: e.short_tokens(F.col("n")), workflow=lambda: e.short_tokens(F.col("n"), whole=True))


def _short(spark, sf):
    m = F.floor("o_totalprice") * (F.col("o_orderkey") % 5)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), e.short_tokens(m).alias("s"), e.short_tokens(m, whole=True).alias("whole"))


query("f13_nearest_command", per_customer_sql("SELECT * FROM (VALUES (1, 'sesion-audit', 'session-audit', 1), (2, 'tool-adit', 'tool-audit', 1)) t(id, word, best, distance)", "", "id"))(lambda s, d: _nearest(s, d))


def _nearest(spark, sf):
    words = per_customer(spark, sf, [(1, "sesion-audit"), (2, "tool-adit"), (3, "nothing-like-it-at-all-§")], "id long, word string", (), ("id",))
    known = F.array(*map(F.lit, ["session-audit", "tool-audit", "stats"]))
    scored = F.transform(known, lambda c: F.struct(F.levenshtein(F.col("word"), c).alias("distance"), c.alias("best")))
    return words.select("id", "word", F.array_min(scored).alias("m")).where("m.distance <= 3").select("id", "word", "m.best", "m.distance")


query("f14_version_order", "SELECT p_partkey AS id, (p_size, p_partkey % 7) > (25, 3) AS newer FROM part")(lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("id"), (e.version_key(F.concat(F.lit("^v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"))) > F.array(F.lit(25), F.lit(3))).alias("newer")))
_v("f15_int_or_null", "SELECT * FROM (VALUES (1, 12::BIGINT), (2, -3), (3, NULL), (4, NULL), (5, NULL)) t(id, n)", [(1, "12"), (2, "-3"), (3, "1.0"), (4, "x"), (5, None)], "id int, t string", n=lambda: e.int_or_null(F.col("t")))
query("f16_base36", per_customer_sql("SELECT * FROM (VALUES (1, '0'), (2, 'z'), (3, '10'), (4, 'zz')) t(id, s)", "", "id"))(lambda s, d: per_customer(s, d, [(1, 0), (2, 35), (3, 36), (4, 1295)], "id int, t long", (), ("id",)).select("id", e.base36(F.col("t")).alias("s")))
_v("f17_paths", "SELECT * FROM (VALUES (1, 'c§.ts', 'a/b', '.ts'), (2, 'x', '.', ''), (3, '.env', 'd', '')) t(id, base, dir, ext)", [(1, "a/b/c§.ts"), (2, "x"), (3, "d/.env")], "id int, p string", base=lambda: e.basename(F.col("p")), dir=lambda: e.dirname(F.col("p")), ext=lambda: e.extension(F.col("p")))
_v("f18_test_names", "SELECT * FROM (VALUES (1, 'tests/a§/x.test.ts', 'x.ts'), (2, 'lib/y.test.py', 'y.py'), (3, 'lib/y_test.test.go', 'y.go')) t(id, test, source)", [(1, "src/a§/x.ts"), (2, "lib/y.py"), (3, "lib/y_test.go")], "id int, p string", test=lambda: e.test_path(F.col("p")), source=lambda: e.source_name(F.col("p")))
_v("f21_response_budget", "SELECT * FROM (VALUES (1, 1200), (2, NULL)) t(id, budget)", [(1, "do it. Response budget: ~1200 tokens"), (2, "Response budget: ~1 tokens")], "id int, t string", budget=lambda: e.response_budget(F.col("t")))
_v("f22_error_class", "SELECT * FROM (VALUES (1, 'E1'), (2, 'type_error'), (3, 'timeout'), (4, 'EACCES'), (5, 'unknown'), (6, 'parse_error'), (7, 'not_initialized')) t(id, class)", [(1, "E1", "x", "timeout"), (2, None, "TypeError", "m"), (3, None, "Error", "a Timeout hit"), (4, None, "Error", "Permission denied"), (5, None, None, None), (6, "", "SyntaxError", "timeout"), (7, None, "Error", "index Not Initialized")], "id int, c string, n string, m string", **{"class": lambda: e.error_class(F.col("c"), F.col("n"), F.col("m"))})
