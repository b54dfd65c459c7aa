"""Change analytics: diffs, commits, test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.plans.ranges import overlap_join
from lodestrata.plans.spread import dealt, unbroadcast
from lodestrata.sources.gittext import LOG_FIELD

#: Commit classes by prefix, then by whole words, in the order in which they are tried.
PREFIXES = {"feat": "feat", "fix": "fix", "refactor": "refactor", "docs?": "docs", "tests?": "test", "chore": "chore", "style": "style", "perf": "perf"}
KEYWORDS = {
    "fix|bug|hotfix|patch": "fix",
    "tests?|specs?|coverage": "test",
    "refactor|restructure|rename|extract|move": "refactor",
    "docs?|documentation|readme|changelog": "docs",
    "add|new|implement|feature": "feat",
    "style|format|lint": "style",
    "perf|optimiz\\w*|speed|faster?": "perf",
    "chore|bump|deps|ci|build": "chore",
}


def commit_class(message: Column) -> Column:
    m = F.lower(message)
    c = F.when(F.lit(False), "")
    for p, name in PREFIXES.items():
        c = c.when(m.rlike(f"^{p}[:(!\\s]"), name)
    c = c.when(m.rlike("^v?[0-9]+\\.[0-9]+"), "feat")
    for p, name in KEYWORDS.items():
        c = c.when(m.rlike(f"\\b({p})\\b"), name)
    return c.otherwise("other")


def numstat_totals(stat: DataFrame) -> DataFrame:
    """Lines in and out per commit; a dash stands for a binary file and counts 0."""
    n = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))
    return stat.groupBy("id").agg(F.sum(n("ins")).alias("insertions"), F.sum(n("del")).alias("deletions"), F.count_distinct("path").alias("n_files"), F.array_join(F.slice(F.array_sort(F.collect_set("path")), 1, 3), ",").alias("files"))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def log_entries(records: DataFrame) -> DataFrame:
    """Commits of a captured log's records: hash, day, author, message, category, files (path, insertions, deletions) and the sums.

    The first line holds four fields at least, or the record counts for nothing; further lines of three parts or more are
    files, a part that begins with no number counts 0. A record is one row from the source to here: nothing is shuffled.
    """
    lines = F.split(_trimmed(F.col("record")), "\n", -1)
    d = records.where(F.trim("record") != "").withColumn("_lines", lines)
    d = d.withColumn("_f", F.split(F.get("_lines", F.lit(0)), LOG_FIELD, -1)).where(F.size("_f") >= 4)
    number = lambda x: F.coalesce(F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0))
    parts = F.filter(F.transform(F.slice("_lines", 2, F.size("_lines")), lambda x: F.split(_trimmed(x), "\t", -1)), lambda p: F.size(p) >= 3)
    files = F.transform(parts, lambda p: F.struct(F.array_join(F.slice(p, 3, F.size(p)), "\t").alias("path"), number(p[0]).alias("insertions"), number(p[1]).alias("deletions")))
    total = lambda c: F.aggregate(F.transform("files", lambda f: f[c]), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("files", files)
    head = [F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(("hash", "day", "author", "message"))]
    return d.select("file", "pos", *head, commit_class(F.get("_f", F.lit(3))).alias("category"), "files", total("insertions").alias("insertions"), total("deletions").alias("deletions"))


def diff_entries(records: DataFrame) -> DataFrame:
    """Files of a captured diff's records: path, old_path, flags, added and removed lines, and hunks (new_start, new_count, added, removed).

    A file's part is one row from the source to here, and its hunks stay inside: nothing is shuffled. Lines count inside
    hunks alone, those that begin with +++ or --- never; a hunk whose header cannot be read starts at 0 and has length 1.
    """
    r = F.col("record")
    head = F.substring_index(r, "\n", 1)
    name = lambda i: F.regexp_extract(head, "^a/(.+?) b/(.+)", i)
    has = lambda line: r.rlike(f"(?md)^{line}")
    renamed = F.regexp_extract_all(r, F.lit("(?md)^rename from (.*)$"), 1)
    was = F.when(name(1) != name(2), name(1))
    count = lambda h, sign, rest: F.regexp_count(h, F.lit(f"(?md)^{sign}(?!{rest})")).cast("long")
    at = r"^@@ -[0-9]+(?:,[0-9]+)? \+([0-9]+)(?:,([0-9]+))? @@"

    def hunk(h: Column) -> Column:
        first = F.substring_index(h, "\n", 1)
        start, n = F.regexp_extract(first, at, 1).try_cast("bigint"), F.regexp_extract(first, at, 2).try_cast("bigint")
        return F.struct(F.coalesce(start, F.lit(0)).alias("new_start"), F.coalesce(n, F.lit(1)).alias("new_count"), count(h, r"\+", r"\+\+").alias("added"), count(h, "-", "--").alias("removed"))

    parts = F.split(r, "\n(?=@@ )", -1)
    d = records.withColumn("hunks", F.transform(F.slice(parts, 2, F.size(parts)), hunk))
    total = lambda c: F.aggregate(F.transform("hunks", lambda f: f[c]), F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(
        "file", "pos", name(2).alias("path"), F.coalesce(F.try_element_at(renamed, F.lit(-1)), was).alias("old_path"),
        has("new file mode").alias("is_new"), has("deleted file mode").alias("is_deleted"), has("Binary files").alias("is_binary"),
        total("added").alias("added"), total("removed").alias("removed"), "hunks",
    )


def entry_hunks(entries: DataFrame) -> DataFrame:
    """The hunks of diff_entries, a row each, as affected_symbols and regions take them."""
    return entries.select("path", F.posexplode("hunks").alias("i", "h")).select("path", (F.col("i") + 1).alias("hunk_no"), "h.*", (F.col("h.added") > 0).alias("has_added"), (F.col("h.removed") > 0).alias("has_removed"))


def log_summary(commits: DataFrame, totals: DataFrame) -> DataFrame:
    c = commits.withColumn("category", commit_class(F.col("message"))).join(totals, "id", "left")
    return c.groupBy("category").agg(F.count("*").alias("n"), F.coalesce(F.sum("insertions"), F.lit(0)).alias("insertions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"))


def top_authors(commits: DataFrame, k: int = 5) -> DataFrame:
    return commits.groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").limit(k)


def parse_diff(ls: DataFrame) -> DataFrame:
    """Hunks of unified diffs (diff_id, line_no, text): islands of lines after a file's or a hunk's header.

    The file and hunk that a line belongs to are the last headers before it; tallies leave out the --- and
    +++ lines, even inside a hunk.
    """
    t = F.col("text")
    w = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    path = F.when(t.startswith("diff --git "), F.regexp_extract(t, "^diff --git a/.* b/(.*)$", 1))
    d = ls.withColumn("path", F.last(path, True).over(w)).withColumn("header", t.startswith("diff --git "))
    d = d.withColumn("file_no", F.sum(F.col("header").cast("int")).over(w))
    d = d.withColumn("hunk_no", F.sum(t.rlike("^@@ ").cast("int")).over(Window.partitionBy("diff_id", "file_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    return d.where("path is not null")


def file_diffs(parsed: DataFrame) -> DataFrame:
    t = F.col("text")
    head = F.col("hunk_no") == 0
    return parsed.groupBy("diff_id", "file_no", "path").agg(
        F.count_if(t.startswith("+") & ~t.startswith("+++")).alias("added"),
        F.count_if(t.startswith("-") & ~t.startswith("---")).alias("removed"),
        F.bool_or(head & t.startswith("new file mode")).alias("is_new"),
        F.bool_or(head & t.startswith("deleted file mode")).alias("is_deleted"),
        F.bool_or(t.startswith("Binary files")).alias("is_binary"),
        F.max(F.when(head & t.startswith("rename from "), F.substring(t, 13, 10_000))).alias("old_path"),
    )


def hunks(parsed: DataFrame) -> DataFrame:
    """Start and length in the new file; a missing length is 1."""
    g = parsed.where("hunk_no > 0").groupBy("diff_id", "file_no", "path", "hunk_no").agg(F.max(F.when(F.col("text").rlike("^@@ "), F.col("text"))).alias("h"), F.count_if(F.col("text").rlike("^\\+(?!\\+\\+)")).alias("added"), F.count_if(F.col("text").rlike("^-(?!--)")).alias("removed"))
    start = F.regexp_extract("h", "\\+([0-9]+)", 1).cast("long")
    count = F.regexp_extract("h", "\\+[0-9]+,([0-9]+)", 1)
    return g.select("diff_id", "path", "hunk_no", start.alias("new_start"), F.when(count == "", F.lit("1")).otherwise(count).cast("long").alias("new_count"), "added", "removed")


def affected_symbols(hunks_: DataFrame, symbols: DataFrame, parts: int | None = None) -> DataFrame:
    """Symbols that a hunk of their file touches. What kind of change it was is judged by all hunks of the file. parts: of how many tasks, if it is known; rows are then dealt by path."""
    of = dealt(hunks_, parts, "path").groupBy("path").agg(F.bool_or("has_added").alias("a"), F.bool_or("has_removed").alias("r"))
    end = F.when(F.col("new_count") > 0, F.col("new_start") + F.col("new_count") - 1).otherwise(F.col("new_start"))
    hit = overlap_join(symbols, hunks_.select("path", "new_start", end.alias("new_end")), ["path"], ("start_line", "end_line"), ("new_start", "new_end"), parts=parts)
    one = dealt(hit, parts, "path").groupBy("path", "name").agg(F.min("new_start").alias("first_hunk"))
    kind = F.when(F.col("a") & ~F.col("r"), "ADDED").when(F.col("r") & ~F.col("a"), "REMOVED").otherwise("MODIFIED")
    return unbroadcast(one).join(unbroadcast(of), "path").select("path", "name", "first_hunk", kind.alias("change"))


def regions(hunks_: DataFrame, targets: DataFrame) -> DataFrame:
    """Hunks that overlap a target range of their file (start, end)."""
    end = F.greatest(F.col("new_start"), F.col("new_start") + F.col("new_count") - 1)
    return overlap_join(hunks_.withColumn("new_end", end), targets, ["path"], ("new_start", "new_end"), ("start", "end")).select("path", "new_start", "new_count")


def multiset_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines (path, text) by how often they occur more in one snapshot than in the other: counts are joined, not lines."""
    a = old.groupBy("path", "text").agg(F.count("*").alias("was"))
    b = new.groupBy("path", "text").agg(F.count("*").alias("now"))
    d = a.join(b, ["path", "text"], "full").select("path", "text", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"))
    return d.where("was <> now").select("path", "text", (F.col("now") - F.col("was")).alias("change"))


def name_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols added, removed and unchanged between two outlines, by name."""
    a = before.select("path", "name").distinct().withColumn("was", F.lit(True))
    b = after.select("path", "name").distinct().withColumn("now", F.lit(True))
    return a.join(b, ["path", "name"], "full").select("path", "name", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("unchanged").alias("change"))


#: Runner by what its command holds, the first that matches.
RUNNERS = [("vitest", ("vitest",)), ("jest", ("jest",)), ("pytest", ("pytest",)), ("phpunit", ("phpunit",)), ("cargo", ("cargo test",)), ("go", ("go test",)), ("rspec", ("rspec",)), ("mocha", ("mocha",)), ("node", ("node --test", "node:test"))]
#: What the summaries of runners look like.
VITEST_TESTS = r"Tests?\s+(?:(\d+)\s+failed\s*\|?\s*)?(?:(\d+)\s+passed\s*)?(?:\|?\s*(\d+)\s+skipped)?\s*\((\d+)\)"
VITEST_FILES, VITEST_TIME = r"Test Files\s+(?:\d+\s+failed\s*\|?\s*)?(\d+)\s+passed\s*\((\d+)\)", r"Duration\s+([\d.]+\w?\s*(?:\([^)]+\))?)"
JEST_TESTS = r"Tests:\s+(?:(\d+) failed, )?(?:(\d+) skipped, )?(?:(\d+) passed, )?(\d+) total"
PYTEST, PYTEST_FAILED = r"(?m)=+\s*(.*?)\s*=+\s*$", r"(?m)^FAILED\s+(\S+)\s*-?\s*(.*)"
PHPUNIT_OK, PHPUNIT, PHPUNIT_ERRORS, PHPUNIT_TIME, PHPUNIT_FAILED = r"OK\s*\((\d+)\s+test", r"Tests:\s*(\d+).*?Failures:\s*(\d+)", r"Errors:\s*(\d+)", r"Time:\s*([\d.:]+\s*\w*)", r"(?m)^\d+\)\s+(\S+::\S+)"
GO_FAILED, NODE_FAILED = r"(?m)^---\s+FAIL:\s+(\S+)\s+\(([^)]+)\)", r"(?m)^not ok\s+\d+\s*-\s*(.+)$"
CARGO = r"test result:\s*\w+\.\s*(\d+)\s+passed;\s*(\d+)\s+failed;\s*(\d+)\s+ignored"
#: Characters of a failure's name and error, failures and lines that are shown.
NAME_CHARS, ERROR_CHARS, SHOWN, ERROR_LINES = 200, 300, 10, 7


def runner(command: Column, output: Column) -> Column:
    """Which runner wrote an output: by its command, else by the output."""
    cmd, out = F.lower(command), F.lower(output)
    c = F.when(F.lit(False), "")
    for name, parts in RUNNERS:
        for p in parts:
            c = c.when(cmd.contains(p), name)
    c = c.when(out.contains("vite"), "vitest").when(out.contains("jest"), "jest").when(out.contains("pytest") | (out.contains("=== ") & out.contains(" passed")), "pytest").when(out.contains("phpunit"), "phpunit")
    c = c.when(out.contains("--- fail:") | out.contains("--- pass:") | out.contains("ok  \t"), "go").when(output.rlike(r"(?m)^#\s*tests\s+\d+") & output.rlike(r"(?m)^#\s*pass\s+\d+"), "node")
    return c.otherwise("generic")


def _counts(kind: Column, o: Column) -> Column:
    """struct(passed, failed, skipped, total) of an output, by the notation of its runner."""
    has = lambda p: o.rlike(p)
    num = lambda p, i=1, of=o: F.coalesce(F.regexp_extract(of, p, i).try_cast("long"), F.lit(0).cast("long"))
    lines = lambda p: F.regexp_count(o, F.lit(f"(?m){p}")).cast("long")

    def all_of(passed: Column, failed: Column, skipped: Column, total: Column | None = None) -> Column:
        total = passed + failed + skipped if total is None else total
        return F.struct(*[x.cast("long").alias(n) for n, x in (("passed", passed), ("failed", failed), ("skipped", skipped), ("total", total))])

    none = F.lit(0).cast("long")
    vitest = all_of(num(VITEST_TESTS, 2), num(VITEST_TESTS, 1), num(VITEST_TESTS, 3), num(VITEST_TESTS, 4))
    jest = all_of(num(JEST_TESTS, 3), num(JEST_TESTS, 1), num(JEST_TESTS, 2), num(JEST_TESTS, 4))
    line = F.regexp_extract(o, PYTEST, 1)
    pytest = all_of(*[num(rf"(\d+)\s+{w}", 1, line) for w in ("passed", "failed", "skipped")])
    bad = num(PHPUNIT, 2) + num(PHPUNIT_ERRORS)
    phpunit = F.when(has(PHPUNIT), all_of(num(PHPUNIT) - bad, bad, none, num(PHPUNIT))).otherwise(all_of(num(PHPUNIT_OK), none, none))
    marks = [lines(rf"^---\s+{w}:") for w in ("PASS", "FAIL", "SKIP")]
    go = F.when(sum(marks[1:], marks[0]) > 0, all_of(*marks)).otherwise(all_of(lines(r"^ok\s+"), lines(r"^FAIL\s+"), none))
    foot = [num(rf"(?m)^#\s*{w}\s+(\d+)") for w in ("pass", "fail", "skipped")]
    total = F.when(has(r"(?m)^#\s*tests\s+\d+"), num(r"(?m)^#\s*tests\s+(\d+)")).otherwise(sum(foot[1:], foot[0]))
    node = F.when(has(r"(?m)^#\s*(pass|fail)\s+\d+"), all_of(*foot, total)).otherwise(all_of(lines(r"^ok\s+\d+"), lines(r"^not ok\s+\d+"), none))
    cargo = all_of(num(CARGO), num(CARGO, 2), num(CARGO, 3))
    parts = [num(rf"(?i)(\d+)\s+(?:{w})") for w in ("passed|passing|ok|success", "failed|failing|error|fail", "skipped|pending|ignored")]
    every = r"(?i)(\d+)\s+(?:total|tests?|specs?)\b"
    generic = all_of(*parts, F.when(has(every), num(every)).otherwise(sum(parts[1:], parts[0])))
    return (
        F.when(kind.isin("vitest", "jest") & has(VITEST_TESTS), vitest).when(kind.isin("vitest", "jest"), jest).when(kind == "pytest", pytest).when(kind == "phpunit", phpunit)
        .when(kind == "go", go).when(kind == "node", node).when(kind == "cargo", cargo).otherwise(generic)
    )


def _failure(name: Column, error: Column) -> Column:
    return F.struct(F.left(name, F.lit(NAME_CHARS)).alias("name"), F.left(error, F.lit(ERROR_CHARS)).alias("error"))


def _failures(kind: Column, o: Column) -> Column:
    """array of struct(name, error) of the failures that an output names."""

    def named(p: str, error=lambda i: F.lit("")) -> Column:
        return F.transform(F.regexp_extract_all(o, F.lit(p), 1), lambda x, i: _failure(F.trim(x), error(i)))

    def block(b: Column) -> Column:
        ls = F.transform(F.slice(F.split(b, "\n", -1), 2, ERROR_LINES), lambda x: F.trim(x))
        end = F.array_position(F.transform(ls, lambda x: x.rlike("^[⎯─]")), True)
        ls = F.filter(ls, lambda x, i: ((end == 0) | (i < end - 1)) & (x != "") & ~x.rlike("^(at |❯)"))
        return _failure(F.trim(F.substring_index(b, "\n", 1)), F.array_join(ls, "\n"))

    blocks = F.slice(F.split(o, r"(?:FAIL|✕|×)\s+", -1), 2, SHOWN)
    vitest = F.filter(F.transform(blocks, block), lambda x: x["name"] != "")
    sections = F.transform(F.slice(F.split(o, r"(?m)^failures:\s*$", -1), 2, 1_000_000), lambda x: F.filter(F.split(x, "\n", -1), lambda y: F.trim(y) != ""))
    lists = F.filter(sections, lambda x: (F.size(x) > 0) & F.forall(x, lambda y: y.rlike(r"^\s+\S+") & ~y.contains("----")))
    cargo = F.transform(F.slice(F.coalesce(F.get(lists, F.lit(0)), F.array().cast("array<string>")), 1, SHOWN), lambda x: _failure(F.trim(x), F.lit("")))
    second = lambda p, lead="": lambda i: F.concat(F.lit(lead), F.get(F.regexp_extract_all(o, F.lit(p), 2), i))
    none = F.array().cast("array<struct<name:string,error:string>>")
    return (
        F.when(kind.isin("vitest", "jest"), vitest).when(kind == "pytest", named(PYTEST_FAILED, second(PYTEST_FAILED))).when(kind == "phpunit", named(PHPUNIT_FAILED))
        .when(kind == "go", named(GO_FAILED, second(GO_FAILED, "duration: "))).when(kind == "node", named(NODE_FAILED)).when(kind == "cargo", cargo).otherwise(none)
    )


def test_runs(outputs: DataFrame) -> DataFrame:
    """What captured test runs (id, command, output, exit_code) say: runner, counts, suites, duration and failures.

    A run that failed without a failed test has one, named after its exit code, with the output's first lines. Of
    summaries with and without a colon behind `Tests` both are read.
    """
    o = F.col("output")
    d = outputs.select("id", "exit_code", "output", runner(F.col("command"), o).alias("runner"))
    d = d.withColumn("c", _counts(F.col("runner"), o)).withColumn("found", _failures(F.col("runner"), o))
    some = lambda x: F.when(x != "", F.trim(x))
    time = F.when(F.col("runner").isin("vitest", "jest"), some(F.regexp_extract(o, VITEST_TIME, 1))).when(F.col("runner") == "pytest", some(F.regexp_extract(F.regexp_extract(o, PYTEST, 1), r"in\s+([\d.]+s)", 1))).when(F.col("runner") == "phpunit", some(F.regexp_extract(o, PHPUNIT_TIME, 1)))
    suites = F.when(F.col("runner").isin("vitest", "jest"), F.regexp_extract(o, VITEST_FILES, 2).try_cast("long"))
    broke = (F.col("exit_code") != 0) & (F.col("c.failed") == 0)
    ls = F.filter(F.transform(F.split(o, "\n", -1), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^(at |>)"))
    why = F.when(F.size(ls) > 0, F.array_join(F.slice(ls, 1, 3), "\n")).otherwise(F.lit("Command failed without producing output."))
    own = F.array(_failure(F.concat(F.lit("Command exited with code "), F.col("exit_code").cast("string")), why))
    return d.select(
        "id", "runner", F.col("c.passed").alias("passed"), F.when(broke, F.lit(1).cast("long")).otherwise(F.col("c.failed")).alias("failed"), F.col("c.skipped").alias("skipped"),
        F.when(broke, F.greatest(F.col("c.total"), F.col("c.passed") + 1 + F.col("c.skipped"))).otherwise(F.col("c.total")).alias("total"),
        suites.alias("suites"), time.alias("duration"), F.when(broke, F.concat(own, F.col("found"))).otherwise(F.col("found")).alias("failures"),
    )


def test_counts(outputs: DataFrame) -> DataFrame:
    return test_runs(outputs).select("id", "runner", "passed", "failed", "skipped", "total")


def test_failures(outputs: DataFrame) -> DataFrame:
    """A row for each failure of a run."""
    return test_runs(outputs).select("id", F.posexplode("failures").alias("ord", "f")).select("id", "ord", "f.name", "f.error")
