"""Rule gates: policies, plans, command and pattern predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Tools that read whole files, and from how many tokens on one is expensive.
FULL_READS = ("smart_read", "smart_read_many")
EXPENSIVE = 500
#: Task marks.
TAGS = ("TODO", "FIXME", "HACK", "XXX", "BUG", "NOTE", "OPTIMIZE", "REFACTOR")
#: Endings of code files in a command, and the patterns of commands and of what wraps them.
CODE_FILE = r"\.(ts|tsx|js|jsx|mjs|cjs|py|rb|go|rs|java|kt|swift|php|cs|cpp|c|h|hpp|scala|clj|ex|exs|elm|ml|fs|dart|lua|sh|bash|zsh)(\s|\z|;|\||&|>|<)"
RECURSIVE_GREP, GREP_BOUND = r"\bgrep\s+[^|]*-[rR]\b", r"\s-m\s+\d+"
WIDE_FIND, FIND_BOUND = r"\bfind\s+(/|~|\$HOME)", r"-maxdepth\s+\d+"
SED_IN_PLACE, LINE_COUNT, SLICE_LINES = r"\bsed\b[^|>]*\s-i\b", r"(?:^|\s)-(?:n\s*)?(\d+)\b", 300
GIT_LOG, LOG_BOUND = r"(^|[;&|\n]\s*)git\s+log\b", r"-n\s*\d+|-N\s*\d+|--max-count=\d+|\s-\d+(\s|\z)|\|\s*head"
GIT_DIFF, DIFF_STAT = r"(^|[;&|\n]\s*)git\s+diff\s*(\z|[|;&])", r"\bgit\s+diff\s+[^\s|]*--stat"
RUN_TESTS = r"\b(?:npm|yarn|pnpm)\s+(?:run\s+)?test(?:[:\s]|\z)|\byarn\s+workspace\s+\S+\s+test\b|\b(?:vitest|jest|mocha|phpunit|rspec|pytest)\b|\bgo\s+test\b|\bcargo\s+test\b"
WRAPPED = (r"\b(?:bash|sh|zsh)\s+-c\s+(?:\"([^\"]+)\"|'([^']+)')", r"\beval\s+(?:\"([^\"]+)\"|'([^']+)')", r"(?s)\b(?:for|while|until)\b[^;]*;\s*do\s+(.+?)\s*;?\s*done\b()")


def policy_advice(calls: DataFrame) -> DataFrame:
    """The first rule that holds after each call; the counters run over the session's calls and count the call itself."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    full = F.col("tool").isin(*FULL_READS)
    c = calls.withColumn("full", full).withColumn("fulls", F.sum(full.cast("int")).over(w)).withColumn("n", F.count("*").over(w)).withColumn("total", F.sum("tokens_returned").over(w))
    advice = F.when(F.col("full") & (F.col("fulls") >= 10), "full_reads").when(F.col("tokens_returned") > 2000, "large").when(F.col("full") & (F.col("tokens_returned") > EXPENSIVE), "expensive").when(F.col("n") % 15 == 0, "many_calls").when((F.col("total") > 8000) & (F.col("n") % 5 == 0), "many_tokens")
    return c.select("event_id", advice.alias("advice")).where("advice is not null")


def cheaper(calls: DataFrame) -> DataFrame:
    """What would have cost less, and how many lines: columns tool, in_context, edited, symbol_known, n_lines, asked."""
    part = lambda share, c: F.floor(share * F.col(c) + 0.5).cast("long")
    t = F.col("tool")
    again = F.col("in_context") & F.col("edited")
    plan = (
        F.when(t.isin("smart_read", "read_symbol") & again, "read_diff")
        .when((t == "smart_read") & F.col("symbol_known") & (F.col("n_lines") > 50), "read_symbol")
        .when((t == "smart_read_many") & F.col("in_context"), "read_diff")
        .when((t == "read_range") & (F.col("asked") > 60) & F.col("symbol_known"), "read_symbol")
    )
    cost = F.when(t.isin("smart_read", "read_symbol") & again, F.greatest(F.lit(20), part(0.1, "n_lines"))).when(t == "smart_read", part(0.15, "n_lines")).when(t == "smart_read_many", F.greatest(F.lit(20), part(0.1, "n_lines"))).when(t == "read_range", part(0.4, "asked"))
    return calls.select("id", plan.alias("plan"), F.when(plan.isNotNull(), cost).alias("lines"))


def read_span(limit: Column, offset: Column, total: Column) -> Column:
    """Lines that a read with an offset and a limit covers; without both all."""
    span = F.greatest(F.lit(0), F.least(F.coalesce(limit, F.lit(2000)), total - F.coalesce(offset, F.lit(0))))
    return F.when(limit.isNull() & offset.isNull(), total).otherwise(span)


def task_scan(pattern: Column) -> Column:
    """Whether a search looks for nothing but task marks."""
    parts = F.split(F.upper(F.regexp_replace(pattern, "[()\\s]", "")), "\\|", -1)
    return F.size(F.array_except(parts, F.array(*map(F.lit, TAGS)))) == 0


def symbol_like(pattern: Column) -> Column:
    """A name in one of the usual cases: camel, Pascal, snake, kebab, or capitals."""
    shape = pattern.rlike("[a-z][A-Z]") | pattern.contains("_") | pattern.contains("-") | pattern.rlike("^[A-Z][A-Z0-9]+$") | pattern.rlike("^[A-Z][a-zA-Z0-9]+$")
    return (F.length(pattern) >= 4) & ~pattern.rlike("[\\\\^$.*+?()\\[\\]{}|\\s]") & pattern.rlike("[A-Za-z]") & shape


def search_gate(pattern: Column, mode: Column) -> Column:
    return F.when(task_scan(pattern), "advise").when(mode == "advisory", "allow").when(symbol_like(pattern), "deny").otherwise("allow")


def _calls(cmd: Column, tool: str) -> Column:
    """The tool stands where a command begins."""
    return cmd.rlike(rf"(?m)(^|[;&|\n]\s*){tool}(\s|$)")


def _one(cmd: Column) -> Column:
    """Each rule's word is looked for before its pattern is, as most commands hold few of them."""
    whole = cmd.rlike(CODE_FILE) & ~cmd.rlike("[|>]")
    n = F.coalesce(F.regexp_extract(cmd, LINE_COUNT, 1).try_cast("int"), F.lit(0))
    return (
        F.when(cmd.contains("grep") & cmd.rlike(RECURSIVE_GREP) & ~cmd.rlike(GREP_BOUND), "deny")
        .when(cmd.contains("find") & cmd.rlike(WIDE_FIND) & ~cmd.rlike(FIND_BOUND), "deny")
        .when(cmd.contains("cat") & _calls(cmd, "cat") & whole & ~cmd.contains("<<"), "deny")
        .when(cmd.contains("sed") & whole & _calls(cmd, "sed") & ~cmd.rlike(SED_IN_PLACE), "deny")
        .when((cmd.contains("head") | cmd.contains("tail")) & whole & (_calls(cmd, "head") | _calls(cmd, "tail")) & (n >= SLICE_LINES), "deny")
        .when(cmd.contains("git") & _calls(cmd, "git") & cmd.rlike(GIT_LOG) & ~cmd.rlike(LOG_BOUND), "deny")
        .when(cmd.contains("git") & cmd.rlike(GIT_DIFF) & ~cmd.rlike(DIFF_STAT), "deny")
        .when(cmd.rlike(RUN_TESTS), "advise")
        .otherwise("allow")
    )


def command_gate(command: Column) -> Column:
    """What shells, eval and loops wrap comes first, of which only a denial counts; then the command itself."""
    cmd = F.trim(command)
    inner = F.concat(*[F.regexp_extract_all(cmd, F.lit(p), k) for p in WRAPPED for k in (1, 2)])
    wraps = cmd.contains("sh") | cmd.contains("eval") | cmd.contains("done")  # what none of these is in wraps nothing
    return F.when(wraps & F.exists(inner, lambda c: _one(F.trim(c)) == "deny"), "deny").otherwise(_one(cmd))


def large_output(text: Column, most: int = 8000) -> Column:
    return F.length(text) >= most


def edit_gate(tool: Column, code: Column, exists: Column, bypass: Column, prepared: Column, mode: Column) -> Column:
    return F.when(bypass | ~code | ~exists | prepared | ~tool.isin("Edit", "MultiEdit", "Write"), "allow").when(mode == "deny", "deny").otherwise("advise")


def task_gate(escaped: Column, matched: Column, picked: Column, mode: Column) -> Column:
    miss = F.coalesce((matched != "") & (matched != picked), F.lit(False))
    return F.when(escaped | ~miss, "allow").when(mode == "deny", "deny").otherwise("advise")


def inside(path: Column, root: str) -> Column:
    """The path, its dot segments resolved at any depth, is the root or under it; a relative path starts at the root. A null path is not."""
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))  # above the file system's root there is nothing
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    base = root.rstrip("/")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))
    tidy = F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), none, step), "/"))
    return F.coalesce((tidy == (base or "/")) | tidy.startswith(base + "/"), F.lit(False))


def agent_scores(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """The agent whose words a task's description holds: +2 per quoted trigger, +1 per keyword, -1 per negative word.

    Agents are a fixed small catalogue, which rides along as one array; ties go to the smaller name.
    """
    text = F.lower("description")
    cat = agents.agg(F.sort_array(F.collect_list(F.struct("name", "quoted", "keywords", "negative"))).alias("cat"))
    hits = lambda words: F.size(F.filter(words, lambda w: F.contains(text, F.lower(w))))
    scored = F.transform("cat", lambda a: F.struct((-(2 * hits(a["quoted"]) + hits(a["keywords"]) - hits(a["negative"]))).alias("minus"), a["name"].alias("name"), hits(a["quoted"]).alias("q")))
    best = tasks.crossJoin(F.broadcast(cat)).select("id", F.array_min(F.filter(scored, lambda x: x["minus"] < 0)).alias("b"))
    return best.select("id", F.col("b.name").alias("agent"), F.when((F.col("b.minus") <= -3) | (F.col("b.q") > 0), "high").when(F.col("b").isNotNull(), "low").alias("level"))
