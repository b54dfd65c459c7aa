"""Queries over diffs, commits and test results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.operators import changes as c
from lodestrata.plans.scratch import scratch_path
from lodestrata.plans.spread import spread
from lodestrata.sources import gittext as g
from lodestrata.sources.adapters import duck, per_customer, per_customer_sql, table, view

CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '^{p}[:(!\\s]') THEN '{n}'" for p, n in c.PREFIXES.items()) + " WHEN regexp_matches(lower(message), '^v?[0-9]+\\.[0-9]+') THEN 'feat' " + " ".join(f"WHEN regexp_matches(lower(message), '\\b({p})\\b') THEN '{n}'" for p, n in c.KEYWORDS.items()) + " ELSE 'other' END"
TOTALS = "t AS (SELECT id, CAST(sum(coalesce(try_cast(ins AS BIGINT), 0)) AS BIGINT) AS insertions, CAST(sum(coalesce(try_cast(del AS BIGINT), 0)) AS BIGINT) AS deletions, count(DISTINCT path) AS n_files, array_to_string(list_sort(list(DISTINCT path))[1:3], ',') AS files FROM numstat GROUP BY id)"

DIFFS = [
    (1, "diff --git a/src/a§.ts b/src/a§.ts\nindex 1..2 100644\n--- a/src/a.ts\n+++ b/src/a.ts\n@@ -18,9 +18,10 @@ f\n x\n-old\n+new\n+more\n@@ -40 +41 @@\n-a\n+b"),
    (2, "diff --git a/n.py b/n.py\nnew file mode 100644\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n+x\n+y\ndiff --git a/o.png b/o.png\nBinary files a/o.png and b/o.png differ\ndiff --git a/p b/q\nrename from p\nrename to q"),
    (3, "diff --git a/d b/d\ndeleted file mode 100644\n--- a/d\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-x\n-y"),
    (4, ""),
]


def _parsed(spark, sf):
    d = spread(per_customer(spark, sf, DIFFS, "diff_id int, raw string", (), ("diff_id",)), "diff_id")
    return c.parse_diff(d.select("diff_id", F.posexplode(F.split("raw", "\n", -1)).alias("line_no", "text")))


RUNS = [
    (1, "npx vitest run", "Test Files  1 failed | 2 passed (3)\n     Tests  1 failed | 54 passed (55)\n  Duration  1.5s", 1), (2, "npx jest", "Tests:       2 failed, 11 passed, 13 total", 1), (3, "pytest -q", "=== 5 passed, 2 skipped in 0.8s ===", 0),
    (4, "vendor/bin/phpunit", "OK (25 tests, 40 assertions)", 0), (5, "phpunit", "1) AppTest\\AuthTest::testLogin§\nFAILURES!\nTests: 25, Assertions: 40, Failures: 3", 2), (6, "go test ./...", "--- PASS: TestFoo (0.00s)\n--- PASS: TestBar (0.01s)\n--- FAIL: TestBaz (0.00s)\n    --- FAIL: TestBaz/sub\nPASS", 1),
    (7, "go test", "ok  \tpkg/a\t0.1s\nFAIL\tpkg/b", 1), (8, "node --test", "not ok 3 - the test name\n# tests 5\n# pass 3\n# fail 1\n# skipped 0", 1), (9, "cargo test", "test result: FAILED. 5 passed; 2 failed; 1 ignored; 0 measured\nfailures:\n\n---- a stdout ----\nfailures:\n    a::b\n    c\n", 101),
    (10, "make check", "4 passing\n1 failing", 1), (11, "./run", "> go\nboom\n  at x\nsecond", 2), (12, "./x", "", 0), (13, "npm test", "vitest v3.2.4", 0), (14, "npm test", "PASS tests/foo.test.js\nJest", 0), (15, "./t", "ok 1 - a\nnot ok 2 - b", 0),
    (16, "node --test", "ok 1 - a\nnot ok 2 - b", 1), (17, "NPX VITEST", "Test Files  2 passed (2)\n     Tests  55 passed (55)\n  Duration  980ms", 0), (18, "x", "7 PASSED of 9 tests", 0), (19, "pytest", "FAILED tests/test_auth.py::test_login - AssertionError: wrong status §\nFAILED tests/test_api.py::test_endpoint - ValueError\n===== 3 passed, 2 failed in 2.5s =====", 1),
    (20, "vitest", "FAIL  tests/foo.test.ts > describe > should work\nAssertionError: expected 1 to be 2\n\nTests  1 failed (1)", 1),
]

query("c07_commit_class", duck("commits") + f" SELECT hash, {CLASS_SQL} AS category FROM commits")(lambda s, d: view(s, d, "commits").select("hash", c.commit_class(F.col("message")).alias("category")))
query("c06_numstat_totals", duck("numstat") + f", {TOTALS} SELECT * FROM t")(lambda s, d: c.numstat_totals(view(s, d, "numstat")))
query("c08_log_summary", duck("commits", "numstat") + f", {TOTALS} SELECT {CLASS_SQL} AS category, count(*) AS n, CAST(coalesce(sum(insertions), 0) AS BIGINT) AS insertions, CAST(coalesce(sum(deletions), 0) AS BIGINT) AS deletions FROM commits LEFT JOIN t USING (id) GROUP BY 1")(lambda s, d: c.log_summary(view(s, d, "commits"), c.numstat_totals(view(s, d, "numstat"))))
query("c08_top_authors", duck("commits") + " SELECT author, count(*) AS n FROM commits GROUP BY author ORDER BY n DESC, author LIMIT 5")(lambda s, d: c.top_authors(view(s, d, "commits")))
query("t22_log_window", duck("commits") + f" SELECT hash, day, {CLASS_SQL} AS category FROM commits ORDER BY day DESC, hash LIMIT 10")(lambda s, d: view(s, d, "commits").select("hash", "day", c.commit_class(F.col("message")).alias("category")).orderBy(F.desc("day"), "hash").limit(10))
query("c01_file_diffs", per_customer_sql("""SELECT * FROM (VALUES (1, 1::BIGINT, 'src/a§.ts', 3::BIGINT, 2::BIGINT, false, false, false, NULL), (2, 1, 'n.py', 2, 0, true, false, false, NULL), (2, 2, 'o.png', 0, 0, false, false, true, NULL), (2, 3, 'q', 0, 0, false, false, false, 'p'), (3, 1, 'd', 0, 2, false, true, false, NULL))
t(diff_id, file_no, path, added, removed, is_new, is_deleted, is_binary, old_path)""", "", "diff_id", "path"))(lambda s, d: c.file_diffs(_parsed(s, d)))
query("c01_hunks", per_customer_sql("""SELECT * FROM (VALUES (1, 'src/a§.ts', 1::BIGINT, 18::BIGINT, 10::BIGINT, 2::BIGINT, 1::BIGINT), (1, 'src/a§.ts', 2, 41, 1, 1, 1), (2, 'n.py', 1, 1, 2, 2, 0), (3, 'd', 1, 0, 0, 0, 2)) t(diff_id, path, hunk_no, new_start, new_count, added, removed)""", "", "diff_id", "path"))(lambda s, d: c.hunks(_parsed(s, d)))
query("c03_affected_symbols", duck("symbols", "hunks") + """, h AS (SELECT *, CASE WHEN new_count > 0 THEN new_start + new_count - 1 ELSE new_start END AS new_end FROM hunks), f AS (SELECT path, bool_or(has_added) AS a, bool_or(has_removed) AS r FROM hunks GROUP BY path)
SELECT s.path, s.name, min(h.new_start) AS first_hunk, any_value(CASE WHEN a AND NOT r THEN 'ADDED' WHEN r AND NOT a THEN 'REMOVED' ELSE 'MODIFIED' END) AS change
FROM symbols s JOIN h ON h.path = s.path AND h.new_start <= s.end_line AND h.new_end >= s.start_line JOIN f ON f.path = s.path GROUP BY s.path, s.name""")(lambda s, d: c.affected_symbols(view(s, d, "hunks"), view(s, d, "symbols")))
query("c04_regions", duck("hunks") + " SELECT path, new_start, new_count FROM hunks WHERE path % 10 = 0 AND new_start <= 30 AND greatest(new_start, new_start + new_count - 1) >= 20")(lambda s, d: c.regions(view(s, d, "hunks"), view(s, d, "hunks").where("path % 10 = 0").select("path", F.lit(20).alias("start"), F.lit(30).alias("end")).distinct()))
query("c05_multiset_diff", """WITH l AS (SELECT doc_id, source AS path, unnest(string_split(text, chr(10))) AS text FROM documents), a AS (SELECT path, text, count(*) AS was FROM l WHERE doc_id % 3 <> 0 GROUP BY ALL), b AS (SELECT path, text, count(*) AS now FROM l WHERE doc_id % 3 <> 1 GROUP BY ALL)
SELECT path, text, coalesce(now, 0) - coalesce(was, 0) AS change FROM a FULL JOIN b USING (path, text) WHERE coalesce(now, 0) <> coalesce(was, 0)""")(lambda s, d: _snapshots(s, d))


def _snapshots(spark, sf):
    ls = table(spark, sf, "documents").select("doc_id", F.col("source").alias("path"), F.explode(F.split("text", "\n", -1)).alias("text"))
    return c.multiset_diff(ls.where("doc_id % 3 <> 0"), ls.where("doc_id % 3 <> 1"))


query("j14_name_delta", duck("symbols") + """, a AS (SELECT DISTINCT path, name FROM symbols WHERE start_line < 40), b AS (SELECT DISTINCT path, name FROM symbols WHERE start_line > 20)
SELECT path, name, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (path, name)""")(lambda s, d: c.name_delta(view(s, d, "symbols").where("start_line < 40"), view(s, d, "symbols").where("start_line > 20")))
COUNTS = [
    (1, "vitest", 54, 1, 0, 55), (2, "jest", 11, 2, 0, 13), (3, "pytest", 5, 0, 2, 7), (4, "phpunit", 25, 0, 0, 25), (5, "phpunit", 22, 3, 0, 25), (6, "go", 2, 1, 0, 3), (7, "go", 1, 1, 0, 2), (8, "node", 3, 1, 0, 5), (9, "cargo", 5, 2, 1, 8),
    (10, "generic", 4, 1, 0, 5), (11, "generic", 0, 1, 0, 1), (12, "generic", 0, 0, 0, 0), (13, "vitest", 0, 0, 0, 0), (14, "jest", 0, 0, 0, 0), (15, "generic", 0, 0, 0, 0), (16, "node", 1, 1, 0, 2), (17, "vitest", 55, 0, 0, 55), (18, "generic", 7, 0, 0, 9),
    (19, "pytest", 3, 2, 0, 5), (20, "vitest", 0, 1, 0, 1),
]
FAILED = [
    (5, 0, "AppTest\\AuthTest::testLogin§", ""), (6, 0, "TestBaz", "duration: 0.00s"), (8, 0, "the test name", ""), (9, 0, "a::b", ""), (9, 1, "c", ""), (11, 0, "Command exited with code 2", "boom\nsecond"), (16, 0, "b", ""),
    (19, 0, "tests/test_auth.py::test_login", "AssertionError: wrong status §"), (19, 1, "tests/test_api.py::test_endpoint", "ValueError"),
    (20, 0, "tests/foo.test.ts > describe > should work", "AssertionError: expected 1 to be 2\nTests  1 failed (1)"),
]


def _listed(rows, names):
    quoted = lambda v: "NULL" if v is None else f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return per_customer_sql(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})", "", "id", ", ".join(n for n in names.split(", ") if n in ("name", "error")))


def _runs(spark, sf):
    return per_customer(spark, sf, RUNS, "id long, command string, output string, exit_code int", (), ("id",))


query("u01_test_counts", _listed(COUNTS, "id, runner, passed, failed, skipped, total"))(lambda s, d: c.test_counts(_runs(s, d)))
query("u02_failures", _listed(FAILED, "id, ord, name, error"))(lambda s, d: c.test_failures(_runs(s, d)).withColumn("ord", F.col("ord").cast("long")))
query("u02_suites_and_times", _listed([(1, 3, "1.5s"), (3, None, "0.8s"), (17, 2, "980m"), (19, None, "2.5s")], "id, suites, duration"))(lambda s, d: c.test_runs(_runs(s, d)).where("suites is not null or duration is not null").select("id", "suites", "duration"))


def _captured(df, name):
    """A captured text: the rows of one column, each with a line break behind it."""
    path = scratch_path(df.sparkSession, name)
    df.write.text(path)
    return path


def _log(spark, sf):
    """The commits as a captured log, read back in ranges that cut separators and records."""
    line = F.struct("path", F.concat_ws("\t", "ins", "del", "path").alias("line"))
    stat = view(spark, sf, "numstat").groupBy("id").agg(F.array_sort(F.collect_list(line)).alias("stat"))
    head = F.concat(F.lit(g.LOG_RECORD), F.concat_ws(g.LOG_FIELD, "hash", F.col("day").cast("string"), "author", "message"))
    body = F.concat(head, F.lit("\n\n"), F.coalesce(F.array_join(F.transform("stat", lambda x: x["line"]), "\n"), F.lit("")))
    return g.git_text(spark, _captured(view(spark, sf, "commits").join(stat, "id", "left").select(body.alias("value")), "log"), "log", 1 << 16)


query("s16_git_log", duck("commits", "numstat") + f""", s AS (SELECT id, count(*) AS n, CAST(sum(coalesce(try_cast(ins AS BIGINT), 0)) AS BIGINT) AS insertions, CAST(sum(coalesce(try_cast(del AS BIGINT), 0)) AS BIGINT) AS deletions, array_to_string(list_sort(list(path)), ',') AS files FROM numstat GROUP BY id)
SELECT hash, CAST(day AS VARCHAR) AS day, author, message, {CLASS_SQL} AS category, coalesce(n, 0) AS n_files, coalesce(files, '') AS files, coalesce(insertions, 0) AS insertions, coalesce(deletions, 0) AS deletions FROM commits LEFT JOIN s USING (id)""")(
    lambda s, d: c.log_entries(_log(s, d)).select("hash", "day", "author", "message", "category", F.size("files").cast("long").alias("n_files"), F.array_join("files.path", ",").alias("files"), "insertions", "deletions")
)


def _diff(spark, sf):
    """Every document against the one of the next lower id, as one captured diff: the whole text goes, the whole text comes."""
    d = view(spark, sf, "files").select("doc_id", "path", F.coalesce("content", F.lit("")).alias("content"))
    old = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("path").alias("was"), F.col("content").alias("before"))
    both = d.join(old, "doc_id", "full")
    signed = lambda sign, x: F.concat(F.lit(f"\n{sign}"), F.replace(x, F.lit("\n"), F.lit(f"\n{sign}")))
    n = lambda x: F.size(F.split(x, "\n", -1)).cast("string")
    a, b = F.coalesce("was", "path"), F.coalesce("path", "was")
    kind = F.when(F.col("was").isNull(), "\nnew file mode 100644").when(F.col("path").isNull(), "\ndeleted file mode 100644").otherwise(F.concat(F.lit("\nrename from "), a, F.lit("\nrename to "), b))
    span = F.concat(F.lit("\n@@ -"), F.coalesce(F.concat(F.lit("1,"), n(F.col("before"))), F.lit("0,0")), F.lit(" +"), F.coalesce(F.concat(F.lit("1,"), n(F.col("content"))), F.lit("0,0")), F.lit(" @@ all"))
    text = F.concat(F.lit(g.DIFF_RECORD + "a/"), a, F.lit(" b/"), b, kind, F.lit("\n--- a/"), a, F.lit("\n+++ b/"), b, span, F.coalesce(signed("-", F.col("before")), F.lit("")), F.coalesce(signed("+", F.col("content")), F.lit("")))
    return c.diff_entries(g.git_text(spark, _captured(both.select(text.alias("value")), "diff"), "diff", 1 << 18))


DIFF_SQL = duck("files") + """, d AS (SELECT doc_id, path, string_split(coalesce(content, ''), chr(10)) AS l FROM files), p AS (SELECT b.path AS path, a.path AS was, b.l AS now, a.l AS before FROM d b FULL JOIN (SELECT doc_id + 1 AS doc_id, path, l FROM d) a USING (doc_id)),
q AS (SELECT coalesce(path, was) AS path, was, path IS NULL AS is_deleted, was IS NULL AS is_new, CAST(coalesce(len(now), 0) AS BIGINT) AS n_now, CAST(coalesce(len(list_filter(now, lambda x: NOT starts_with(x, '++'))), 0) AS BIGINT) AS added, CAST(coalesce(len(list_filter(before, lambda x: NOT starts_with(x, '--'))), 0) AS BIGINT) AS removed FROM p)"""
query("s17_git_diff_files", f"{DIFF_SQL} SELECT path, CASE WHEN NOT is_deleted AND NOT is_new THEN was END AS old_path, is_new, is_deleted, false AS is_binary, added, removed FROM q")(lambda s, d: _diff(s, d).select("path", "old_path", "is_new", "is_deleted", "is_binary", "added", "removed"))
query("s17_git_diff_hunks", f"{DIFF_SQL} SELECT path, CAST(1 AS INTEGER) AS hunk_no, CASE WHEN is_deleted THEN 0 ELSE 1 END::BIGINT AS new_start, n_now AS new_count, added, removed FROM q")(lambda s, d: c.entry_hunks(_diff(s, d)).select("path", "hunk_no", "new_start", "new_count", "added", "removed"))


def _names(spark, sf):
    """The files of each commit of the last day, captured as one list of names under the first ref."""
    last = view(spark, sf, "commits").groupBy().agg(F.max("day").alias("day"))
    ids = view(spark, sf, "commits").join(F.broadcast(last), "day", "left_semi").select("id")
    folder = scratch_path(spark, "names")
    view(spark, sf, "numstat").join(ids, "id").select(F.col("path").alias("value")).write.text(f"{folder}/{g.NAME_REFS[0]}")
    return g.changed_names(spark, folder)


query("s18_changed_names", duck("commits", "numstat") + " SELECT DISTINCT path FROM numstat WHERE id IN (SELECT id FROM commits WHERE day = (SELECT max(day) FROM commits))")(_names)
