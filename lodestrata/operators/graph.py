"""References, callers, modules: the graph of a corpus."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.plans.scratch import saved
from lodestrata.plans.spread import spread, unbroadcast
from lodestrata.runtime import ship

#: File endings of each language; an unknown language is taken as an ending itself.
LANGUAGES = {
    "typescript": [".ts", ".tsx"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "php": [".php"], "python": [".py"], "rust": [".rs"], "go": [".go"], "java": [".java"],
    "ruby": [".rb"], "csharp": [".cs"], "kotlin": [".kt", ".kts"], "swift": [".swift"], "dart": [".dart"], "vue": [".vue"], "svelte": [".svelte"],
}
#: Endings of files whose languages use each other.
FAMILIES = {
    "js": "ts tsx js jsx mjs cjs vue svelte", "py": "py pyi", "go": "go", "rs": "rs", "jvm": "java kt kts scala groovy", "dotnet": "cs", "rb": "rb", "php": "php", "swift": "swift",
    "c": "c h cpp cc cxx hpp", "dart": "dart", "elixir": "ex exs",
}
#: What the paths of tests look like, and names that are constructors.
TEST_PATH = r"\.test\.\w+$|\.spec\.\w+$|_test\.\w+$|test_[^/]+\.\w+$|__tests__/|/tests?/"
CONSTRUCTORS = ("constructor", "__init__", "__new__", "__del__")


def boundary(text: Column, symbol: str) -> Column:
    """The symbol stands alone: no identifier character on either side. The symbol is escaped."""
    return text.rlike(rf"(?<![A-Za-z0-9_]){re.escape(symbol)}(?![A-Za-z0-9_])")


def section_of_hit(text: Column) -> Column:
    return F.when(text.rlike(r"\bimport\b"), "import").otherwise("usage")


def merge_hits(refs: DataFrame, hits: DataFrame, symbol: str) -> DataFrame:
    """Search hits that the index does not know, joined to what it knows."""
    new = hits.where(boundary(F.col("text"), symbol)).join(refs.select("path", "line"), ["path", "line"], "left_anti")
    return refs.select("path", "line", "section").unionByName(new.select("path", "line", section_of_hit(F.col("text")).alias("section")))


def usages(refs: DataFrame, scope: str | None = None, lang: str | None = None, kind: str | None = None, limit: int = 50, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Scope (a part of the path), then language, then kind, then at most `limit` of each section, in order of path and line."""
    if scope:
        refs = refs.where(F.col("path").contains(scope))
    if lang:
        ends = LANGUAGES.get(lang.lower(), [f".{lang}"])
        cond = F.lit(False)
        for x in ends:
            cond = cond | F.col("path").endswith(x)
        refs = refs.where(cond)
    if kind:
        refs = refs.where(F.col("section") == kind)
    w = Window.partitionBy(*by, "section").orderBy("path", "line")
    return refs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def usage_counts(found: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Totals after the limit."""
    return found.groupBy(*by).agg(*[F.count_if(F.col("section") == s).alias(f"n_{s}") for s in ("definition", "import", "usage")], F.count("*").alias("total"))


def usage_list(found: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per file its distinct lines in order."""
    return found.groupBy(*by, "path").agg(F.array_join(F.transform(F.array_sort(F.collect_set("line")), lambda x: x.cast("string")), ",").alias("lines"))


def affected_files(found: DataFrame) -> DataFrame:
    return found.select("path").distinct()


def context_lines(found: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """Lines around each hit: hits are dealt to the few lines they cover, then joined by path and line."""
    near = found.select("path", "line").distinct().select("path", F.col("line").alias("hit"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("line") - k).cast("long"), (F.col("line") + k).cast("long"))).alias("line_no"))
    return near.join(lines, ["path", "line_no"]).select("path", "hit", "line_no", "text")


def callers(refs: DataFrame, limit: int = 10, shown: int = 5) -> DataFrame:
    """Of each symbol's first refs the first usages."""
    w = Window.partitionBy("symbol").orderBy("path", "line")
    first = refs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).where("section = 'usage'")
    return first.withColumn("_m", F.row_number().over(w)).where(F.col("_m") <= shown).select("symbol", "path", "line")


def unused(definitions: DataFrame, refs: DataFrame, limit: int | None = None) -> DataFrame:
    """Definitions without references, without constructors and dunders; with a limit, the first by name."""
    d = definitions.where(~F.col("name").isin(*CONSTRUCTORS) & ~F.col("name").rlike("^__.*__$"))
    d = d.join(refs.select(F.col("symbol").alias("name")).distinct(), "name", "left_anti")
    return d if limit is None else d.orderBy("name").limit(limit)


def related(evidence: DataFrame) -> DataFrame:
    """Evidence rows (path, score, tag) summed to a score, a set of tags and a bucket."""
    g = evidence.groupBy("path").agg(F.sum("score").cast("long").alias("score"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
    return g.withColumn("bucket", F.when(F.col("score") >= 5, "high").when(F.col("score") >= 3, "medium").otherwise("low"))


def family(path: Column) -> Column:
    """The family of a path's language; null for endings of none."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    c = F.when(F.lit(False), "")
    for name, ends in FAMILIES.items():
        c = c.when(ending.isin(ends.split()), name)
    return c


def related_files(refs: DataFrame, imports: DataFrame, files: DataFrame, target: str, changed: DataFrame, symbols: int = 10, most: int = 30) -> DataFrame:
    """Files tied to a target by evidence that adds up.

    refs: (symbol, path, line, section); imports: (path, source), a row for each import statement; files and
    changed: (path). +4 for each import of the target that leads to a file; +3 for a file that refers to one of the target's
    first symbols, or to its name, among each symbol's first imports and first usages, and +1 for each further reference,
    if the languages are of one family; +2 for the target's directory at each import and importer; +5 for
    tests whose names hold the target's; +2 for changed files among all these.
    """
    folder, _, name = target.rpartition("/")
    base = re.sub(r"\.\w+$", "", name)
    score = lambda n, tag: (F.lit(n).cast("long").alias("score"), F.lit(tag).alias("tag"))
    near = F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1) == folder
    used = imports.where((F.col("path") == target) & (F.col("source") != target)).select(F.col("source").alias("path"))
    mine = refs.where((F.col("path") == target) & (F.col("section") == "definition")).select("symbol", "line").orderBy("line", "symbol").limit(symbols).select("symbol")
    asked = F.broadcast(mine.union(refs.sparkSession.createDataFrame([(base,)], "symbol string")).distinct())  # eleven names at most
    w = Window.partitionBy("symbol", "section").orderBy("path", "line")
    first = refs.where("section <> 'definition'").join(asked, "symbol").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    alike = F.coalesce(family(F.col("path")) == family(F.lit(target)), F.lit(True))
    users = first.where((F.col("path") != target) & alike).groupBy("path").agg(F.count("*").alias("n"))
    found = used.select("path", *score(4, "import")).unionByName(used.where(near).select("path", *score(2, "same-dir")))
    found = found.unionByName(users.select("path", *score(3, "importer"))).unionByName(users.where(near).select("path", *score(2, "same-dir")))
    found = found.unionByName(users.where("n > 1").select("path", (F.col("n") - 1).cast("long").alias("score"), F.lit("multi-ref").alias("tag")))
    tests = files.where(F.substring_index("path", "/", -1).contains(base) & F.col("path").rlike(TEST_PATH))
    found = found.unionByName(tests.select("path", *score(5, "test")))
    recent = found.select("path").distinct().join(changed.select("path").distinct(), "path", "left_semi")
    return related(found.unionByName(recent.select("path", *score(2, "changed"))))


def _distances(edges: DataFrame, goal: int, most: int) -> DataFrame:
    """(node, left): the least number of edges from each node to the goal, up to a number; each round asks only for nodes not seen yet."""
    seen = edges.sparkSession.createDataFrame([(goal, 0)], "node long, left int")
    last = seen
    for k in range(1, most + 1):
        new = edges.join(last.select(F.col("node").alias("dep")), "dep").select(F.col("module").alias("node")).distinct().join(seen, "node", "left_anti")
        last = saved(new.withColumn("left", F.lit(k)), "distances")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return saved(seen, "distances")


def routes(spark: SparkSession, edges: DataFrame, start: int, goal: int, max_depth: int = 20, max_paths: int = 50, kind: str | None = None) -> DataFrame:
    """Simple paths between two modules, shortest first, ties by text; a path is a text of names that also guards against cycles.

    A pass back from the goal tells how far each module is from it. Then lengths are tried from the least on, until enough
    paths are found: a path grows only to modules from which the goal can still be reached in time. Of the shortest
    length every such path leads on, so of these no more are kept than are asked for. A goal that cannot be reached costs the
    pass back alone.
    """
    e = edges if kind is None else edges.where(F.col("kind") == kind)
    e = saved(e.select(F.col("module").cast("long").alias("module"), F.col("dep").cast("long").alias("dep")).distinct(), "edges")
    none = spark.createDataFrame([], "path string, depth int")
    if start == goal:
        return none
    left = _distances(e, goal, max_depth)
    first = left.where(F.col("node") == start).select("left").first()
    if first is None:
        return none
    step = saved(e.join(left.select(F.col("node").alias("dep"), "left"), "dep"), "steps")
    found, n = none, 0
    for length in range(first.left, max_depth + 1):
        at = spark.createDataFrame([(start, f">{start}>")], "node long, path string")
        for depth in range(1, length + 1):
            nxt = at.join(step.where(F.col("left") <= length - depth), at["node"] == step["module"])
            # the goal ends a path: before the last edge it is passed over
            nxt = nxt.where(~F.contains("path", F.concat(F.lit(">"), F.col("dep").cast("string"), F.lit(">"))) & ((F.col("dep") == goal) == F.lit(depth == length)))
            nxt = nxt.select(F.col("dep").alias("node"), F.concat("path", F.col("dep").cast("string"), F.lit(">")).alias("path"))
            at = saved(nxt.orderBy("path").limit(max_paths) if length == first.left else nxt, "paths")
            if at.isEmpty():
                break
        hits = at.where(F.col("node") == goal).select("path", F.lit(length).alias("depth"))
        found = found.unionByName(hits)
        n += hits.count()
        if n >= max_paths:
            break
    return found.orderBy("depth", "path").limit(max_paths)


def call_tree(spark: SparkSession, edges: DataFrame, root: int, depth: int = 3) -> DataFrame:
    """Callers of callers of a function to a depth of 1 to 6, with the path that led to each; a level at a time, so its rows have no limit."""
    e = saved(edges.select(F.col("module").cast("long").alias("module"), F.col("dep").cast("long").alias("dep")).distinct(), "edges")
    at = spark.createDataFrame([(root, f">{root}>")], "node long, path string")
    every = spark.createDataFrame([], "node long, path string, depth int")
    for k in range(1, max(1, min(6, depth)) + 1):
        nxt = at.join(e, at["node"] == e["dep"]).where(~F.contains("path", F.concat(F.lit(">"), F.col("module").cast("string"), F.lit(">"))))
        at = saved(nxt.select(F.col("module").alias("node"), F.concat("path", F.col("module").cast("string"), F.lit(">")).alias("path")), "callers")
        if at.isEmpty():
            break
        every = every.unionByName(at.withColumn("depth", F.lit(k)))
    return every


def walk_counts(edges: DataFrame, root: int, depth: int = 20) -> DataFrame:
    """(node, depth, n): in how many ways so many calls lead from each function to the root, repeated functions included. Ways are counted, not listed.

    Counts are exact up to 38 digits, which ways of up to 20 calls do not reach as long as a function has fewer than 79 callers;
    beyond that they are null.
    """
    e = saved(edges.select(F.col("module").cast("long").alias("module"), F.col("dep").cast("long").alias("dep")).distinct(), "edges")
    spark = edges.sparkSession
    at = spark.createDataFrame([(root,)], "node long").withColumn("n", F.lit(1).cast("decimal(38,0)"))
    every = []
    for k in range(1, depth + 1):
        nxt = at.join(e, at["node"] == e["dep"]).groupBy(F.col("module").alias("node")).agg(F.try_sum("n").cast("decimal(38,0)").alias("n"))
        at = saved(nxt, "ways")
        if at.isEmpty():
            break
        every.append(at.withColumn("depth", F.lit(k)).select("node", "depth", "n"))
    out = spark.createDataFrame([], "node long, depth int, n decimal(38,0)")
    for x in every:
        out = out.unionByName(x)
    return out


def transitive(spark: SparkSession, edges: DataFrame, root: int, depth: int = 20) -> DataFrame:
    """Direct and transitive dependencies of a module with their least depth, breadth first: each round asks only for modules not seen yet."""
    e = saved(edges.select(F.col("module").cast("long").alias("module"), F.col("dep").cast("long").alias("node")).distinct(), "edges")
    seen = spark.createDataFrame([(root, 0)], "node long, depth int")
    last = seen
    for k in range(1, depth + 1):
        new = e.join(last.select(F.col("node").alias("module")), "module").select("node").distinct().join(seen, "node", "left_anti")
        last = saved(new.withColumn("depth", F.lit(k)), "reached")
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
    return seen.where("depth > 0")


def module_info(edges: DataFrame, module: int) -> DataFrame:
    a = edges.where(F.col("module") == module).select(F.lit("dependency").alias("role"), F.col("dep").alias("other"), "kind")
    return a.unionByName(edges.where(F.col("dep") == module).select(F.lit("dependent").alias("role"), F.col("module").alias("other"), "kind"))


def unused_deps(edges: DataFrame, uses: DataFrame) -> DataFrame:
    """Edges of which no symbol is used."""
    return edges.join(uses, ["module", "dep"], "left_anti").select("module", "dep")


def search(parts: list[DataFrame], limit: int) -> DataFrame:
    """Hits of several indexes, the first of each (path, line) by the order of the indexes."""
    every = parts[0].withColumn("source", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("source", F.lit(k)))
    one = every.groupBy("path", "line").agg(F.min("source").alias("source"))
    return one.orderBy("source", "path", "line").limit(limit)


def explore(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int = 3, restart: float = 0.25) -> DataFrame:
    """Random walk with restart from seeds (node, weight): each round spreads scores along edges (a, b), both ways, by out-degree."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    deg = both.groupBy("a").agg(F.count("*").alias("d"))
    step = both.join(deg, "a")
    total = seeds.agg(F.sum("weight").alias("t"))
    s0 = seeds.crossJoin(total).select("node", (F.col("weight") / F.col("t")).alias("score"))
    score = s0
    for _ in range(rounds):
        moved = score.join(step, score["node"] == step["a"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("score") / F.col("d")).alias("m"))
        score = moved.join(s0.withColumnRenamed("score", "s"), "node", "full").select("node", (F.coalesce("m", F.lit(0.0)) * (1 - restart) + F.coalesce("s", F.lit(0.0)) * restart).alias("score"))
    return nodes.join(score, "node")


def import_kind(source: Column) -> Column:
    """Relative imports are internal; others external, under their scope and name or first part."""
    return F.when(source.startswith("."), "internal").otherwise("external")


def package_name(source: Column) -> Column:
    return F.when(source.startswith("@"), F.regexp_extract(source, "^(@[^/]+/[^/]+)", 1)).otherwise(F.split_part(source, F.lit("/"), F.lit(1)))


def stack(found: DataFrame) -> DataFrame:
    """Of the languages found in each project the one that stands first."""
    order = ["PHP", "Python", "Go", "Rust", "Node"]
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("language"))
    return found.groupBy("project").agg(F.min_by("language", rank).alias("language"), F.count_distinct("language").alias("n"))


#: How likely a walk begins anew at each step, how near ranks are to those of an endless walk, and rounds between two tables.
RESTART, TOLERANCE, PER_TABLE = 0.25, 1e-9, 4


def ranked(edges: DataFrame, seeds: DataFrame, restart: float = RESTART, tolerance: float = TOLERANCE, most: int = 1000) -> DataFrame:
    """(query, node, score): where random walks with restart stand, for many queries at once.

    edges (a, b, and weight if there is one) are followed from a to b in proportion to their weight; seeds (query, node, weight)
    are where a query's walks begin. A walk at a node without edges begins anew. Rounds go on until no query's scores are
    farther than the tolerance, in sum, from where they end; queries that are there drop out, and every few rounds a table ends the
    lineage. Seeds of no weight, or none above zero, give no rows.
    """
    w = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    e = edges.select("a", "b", w.alias("w")).where("w > 0").groupBy("a", "b").agg(F.sum("w").alias("w"))
    out = e.groupBy("a").agg(F.sum("w").alias("total"))
    step = saved(e.join(out, "a").select("a", "b", (F.col("w") / F.col("total")).alias("p")), "steps")
    s = seeds.where("weight > 0").groupBy("query", "node").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    s = saved(s.join(s.groupBy("query").agg(F.sum("weight").alias("t")), "query").select("query", "node", (F.col("weight") / F.col("t")).alias("s")), "seeds")
    c = (1 - restart) ** PER_TABLE
    near = tolerance * (1 - c) / c  # scores that moved so little between two tables are no farther than the tolerance from their end
    ends = saved(e.select(F.col("b").alias("a")).union(s.select("node")).distinct().join(out, "a", "left_anti").select("a", F.lit(None).cast(dict(e.dtypes)["b"]).alias("b"), F.lit(1.0).alias("p")), "ends")
    step, stops = (step, False) if ends.isEmpty() else (step.unionByName(ends), True)
    again = s.select("query", "node", (F.col("s") * restart).alias("x"))
    at, done = s.select("query", "node", F.col("s").alias("score")), None
    for _ in range(0, most, PER_TABLE):
        before = at
        for _ in range(PER_TABLE):
            # each table and each round is read once: moves, and the part that begins anew, meet in one sum
            moved = at.join(step, at["node"] == step["a"]).groupBy("query", F.col("b").alias("node")).agg((F.sum(F.col("score") * F.col("p")) * (1 - restart)).alias("x"))
            if stops:  # what stands at a node without edges goes to its query's seeds
                to = s.select(F.col("query").alias("_q"), F.col("node").alias("_n"), F.col("s").alias("_s"))
                moved = moved.join(to, moved["node"].isNull() & (moved["query"] == to["_q"]), "left").select("query", F.coalesce("node", "_n").alias("node"), (F.col("x") * F.coalesce("_s", F.lit(1.0))).alias("x"))
            at = moved.unionByName(again).groupBy("query", "node").agg(F.sum("x").alias("score"))
        both = at.join(before.withColumnRenamed("score", "was"), ["query", "node"], "full")
        at = saved(both.select("query", "node", F.coalesce("score", F.lit(0.0)).alias("score"), F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))).alias("gap")), "ranks")
        gaps = saved(at.groupBy("query").agg(F.sum("gap").alias("gap")), "gaps")
        at = at.drop("gap")
        rest = gaps.where(F.col("gap") > near).select("query")
        if rest.isEmpty():
            return at if done is None else done.unionByName(at)
        settled = gaps.where(F.col("gap") <= near).select("query")
        if not settled.isEmpty():
            there = at.join(settled, "query", "left_semi")
            done = there if done is None else done.unionByName(there)
            at = at.join(rest, "query", "left_semi")
            again = again.join(rest, "query", "left_semi")
    raise RuntimeError("the walks did not settle")


def top_ranked(ranks: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k best nodes of each query by their rounded score, ties by name; the best of each part first, so no task ranks a whole query."""
    r = ranks.withColumn("score", F.round("score", digits)).withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(64)))
    order = [F.desc("score"), F.col("node")]
    r = r.withColumn("rank", F.row_number().over(Window.partitionBy("query", "_part").orderBy(*order))).where(F.col("rank") <= k).drop("_part")
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


#: Edges of a neighbourhood that one task holds, steps before ranks are first asked for, and neighbourhoods of a task.
WIDE, FIRST_STEPS, PER_TASK = 1 << 21, 4, 4
#: Nodes whose bounds are made close, one by one, in a round; more than these are left to the next.
CLOSE = 64


def _certain(t: pa.Table, k: int, restart: float, digits: int, widest: int, wide: int = WIDE) -> pa.Table:
    """The k best of one query by rounded score, with ties, from its neighbourhood (node, s, near, sizes). If what lies beyond could change
    any, the nodes whose neighbours are to be read next, without a score, or a row without a node if these have more edges than wide.

    Nodes of which no row tells the neighbours are the rim. Walks that never leave by it give the least that a score can be. A walk
    that leaves and comes to a node adds at most the node's degree, times the most that leaves by an edge of the rim, times the chance
    that a walk from the node leaves: walks back are as likely as walks there, but for the degrees. For the nodes that this leaves open the
    most is made closer: walks outside are a symmetric operator of bounded norm, so they add no more than the root of the sums of squares,
    over the rim's unknown edges, of what leaves by an edge from the seeds and from the node.
    """
    node, near, sizes = t["node"].to_numpy(), *(t[c].combine_chunks() for c in ("near", "sizes"))
    n_near = near.value_lengths().to_numpy(zero_copy_only=False)
    ids, where = np.unique(np.concatenate([node, near.flatten().to_numpy()]), return_inverse=True)
    n, at, to = len(ids), where[: len(node)], where[len(node) :]
    d, told, s = np.zeros(n), np.zeros(n, bool), np.zeros(n)
    d[to], told[at], s[at] = sizes.flatten().to_numpy(), True, t["s"].to_numpy() / t["s"].to_numpy().sum()
    d[at] = n_near
    a, back = np.repeat(at, n_near), ~told[to]
    a, b = np.concatenate([a, to[back]]), np.concatenate([to, a[back]])
    moved = lambda x: (1 - restart) * np.bincount(b, x[a], n)
    x = restart * s
    low = x
    while x.sum() > 1e-14:
        x = moved(x / d)
        low = low + x
    unknown = d - np.bincount(a, minlength=n)
    rim, unit = unknown > 0, 10.0**digits
    high, beyond, weight = low, 0.0, None
    # a ten-millionth of a unit for what sums of doubles lose
    least = np.floor(low * unit + 0.5 - 1e-7)
    last_of = lambda x: np.floor(x * unit + 0.5 + 1e-7)
    kth = np.partition(least, n - k)[n - k] if n >= k else -1.0
    if rim.any():
        f = (1 - restart) * unknown / d
        leaves = f
        while f.max() > 1e-5:
            f = moved(f) / d
            leaves = leaves + f
        leaves = leaves + f.max() * (1 - restart) / restart
        most = (1 - restart) / restart * (low[rim] / d[rim]).max()
        high, beyond = low + d * most * leaves, widest * most
        # unknown edges from rim to rim add one step outside to two or more
        kinds = np.unique(ids[rim] & 1)
        factor = (1 - restart) / restart if len(kinds) > 1 else (1 - restart) ** 2 / restart
        leaving = unknown * (low / d) ** 2
        weight = leaving / leaving.sum()
        open_ = np.flatnonzero((last_of(high) >= kth) & (last_of(high) != least))
        if n >= k and len(open_) <= CLOSE:
            high = high.copy()
            for v in open_:
                x = np.zeros(n)
                x[v] = 1.0
                y = x
                while True:
                    for _ in range(4):
                        x = moved(x / d)
                        y = y + x
                    rest = np.sqrt((x * x / d).sum()) / restart
                    norm = np.sqrt((unknown * (y / d) ** 2).sum())
                    if rest <= norm / 100:
                        break
                high[v] = min(high[v], low[v] + d[v] * factor * np.sqrt(leaving.sum()) * (norm + rest))
                if last_of(high[v]) != least[v]:
                    weight = weight + unknown * (y / d) ** 2 / norm**2
    last = last_of(high)
    best = last >= kth
    kind = t["query"].type
    if rim.any() and (n < k or (least[best] != last[best]).any() or last_of(beyond) >= kth):
        # of the rim what weighs most, until so little is left that the open ones may close; all bounds fall with it
        short = ((least[best] + 1 - (low[best] * unit + 0.5)) / ((high[best] - low[best]) * unit + 1e-300)).min() if n >= k else 0.0
        by = np.flatnonzero(rim)
        by = by[np.argsort(-weight[by])]
        left = 1 - np.cumsum(weight[by]) / weight.sum()
        ask = by[: 1 + int((left > np.clip(short / 4, 0.01, 0.5)).sum())]
        if d[at].sum() + d[ask].sum() > wide:
            return pa.table({"query": t["query"][:1].combine_chunks(), "node": pa.array([None], pa.int64()), "score": pa.array([None], pa.float64())})
        return pa.table({"query": pa.array([t["query"][0].as_py()] * len(ask), kind), "node": ids[ask], "score": pa.nulls(len(ask), pa.float64())})
    return pa.table({"query": pa.array([t["query"][0].as_py()] * int(best.sum()), kind), "node": ids[best], "score": low[best]})


def ranked_near(pairs: DataFrame, seeds: DataFrame, k: int, restart: float = RESTART, digits: int = 6, wide: int = WIDE) -> DataFrame:
    """(query, node, score, rank): top_ranked(ranked()) in a graph of two kinds of nodes, whose edges (a, b) are followed both ways, without walks over all of it.

    A query's neighbourhood grows by a few whole steps, then by the nodes of its rim that matter most, until its k best are certain to all digits, or it is
    all that the query's walks can reach; so what is joined grows with queries, not with queries times edges. Queries whose neighbourhood has more edges than a
    task is to hold, or that begin at a node without edges, are walked over the whole graph by ranked(). No name is of both kinds.
    """
    spark = ship(pairs.sparkSession)
    pairs = saved(pairs.select("a", "b").distinct(), "pairs")
    # even numbers for a, odd ones for b
    kinds = [pairs.groupBy(F.col(c).alias("name")).agg(F.count("*").cast("int").alias("d")).withColumn("kind", F.lit(i)) for i, c in enumerate("ab")]
    nodes = saved(kinds[0].unionByName(kinds[1]).select((F.monotonically_increasing_id() * 2 + F.col("kind")).alias("node"), "kind", "name", "d"), "nodes")
    e = pairs
    for i, c in enumerate("ab"):
        e = unbroadcast(e).join(unbroadcast(nodes.where(F.col("kind") == i).select(F.col("name").alias(c), F.col("node").alias(f"{c}_node"), F.col("d").alias(f"{c}_d"))), c)
    e = saved(e.drop("a", "b"), "edges")
    lists = [e.where(F.col(f"{c}_d") <= wide).groupBy(F.col(f"{c}_node").alias("node")).agg(F.collect_list(F.struct(F.col(f"{o}_node").alias("node"), F.col(f"{o}_d").alias("d"))).alias("l")) for c, o in ("ab", "ba")]
    lists = saved(lists[0].unionByName(lists[1]).select("node", F.col("l.node").alias("near"), F.col("l.d").alias("sizes")), "lists")
    # a table of their own, or Spark would ask of all nodes what the seeds' filters ask of seeds
    s = saved(seeds.where("weight > 0").groupBy("query", F.col("node").alias("name")).agg(F.sum(F.col("weight").cast("double")).alias("s")), "seeds")
    widest = nodes.agg(F.max("d")).first()[0] or 0
    kind = dict(s.dtypes)["query"]

    def certain(t: pa.Table) -> pa.Table:
        return _certain(t, k, restart, digits, widest, wide)

    # n: edges of a query's neighbourhood so far; a seed without edges counts as too many
    front = unbroadcast(s).join(unbroadcast(nodes), "name", "left").select("query", "node", F.coalesce("d", F.lit(wide + 1)).alias("d"), "s", F.lit(0).cast("long").alias("n"))
    keyed = lists.withColumnRenamed("node", "_k")
    balls, found, far = [], [], []
    for step in range(FIRST_STEPS):
        front = front.withColumn("n", F.col("n") + F.sum("d").over(Window.partitionBy("query")))
        both = unbroadcast(front.withColumn("_k", F.when(F.col("n") <= wide, F.col("node")))).join(unbroadcast(keyed), "_k", "left")
        ball = saved(both.select("query", "node", "s", "n", "near", "sizes"), "balls")
        n_far = ball.where(F.col("n") > wide).limit(1).count()
        if n_far:
            far.append(ball.where(F.col("n") > wide).select("query").distinct())
            ball = ball.where(F.col("n") <= wide)
        before, balls = balls[-1:], [*balls, ball]
        if step < FIRST_STEPS - 1:
            # from one kind to the other and back: what a step finds was found two steps before, or is new
            new = ball.select("query", "n", F.explode(F.arrays_zip("near", "sizes")).alias("x")).select("query", "n", F.col("x.near").alias("node"), F.col("x.sizes").alias("d")).distinct()
            for x in before:
                new = unbroadcast(new).join(unbroadcast(x.select("query", "node")), ["query", "node"], "left_anti")
            front = new.withColumn("s", F.lit(0.0))
    every = functools.reduce(DataFrame.unionByName, [x.drop("n") for x in balls])
    for x in far:
        every = every.join(x, "query", "left_anti")
    n = s.select("query").distinct().count()
    while True:
        told = saved(spread(every, "query", rows=n, per_task=PER_TASK).groupBy("query").applyInArrow(certain, f"query {kind}, node long, score double"), "found")
        found.append(told.where("score is not null"))
        asked = told.where("score is null and node is not null").select("query", "node")
        if not told.where("node is null").isEmpty():
            far.append(told.where("node is null").select("query"))
        n = asked.agg(F.count_distinct("query")).first()[0]
        if not n:
            break
        more = saved(unbroadcast(asked.withColumnRenamed("node", "_k")).join(unbroadcast(keyed), "_k").select("query", F.col("_k").alias("node"), F.lit(0.0).alias("s"), "near", "sizes"), "balls")
        every = every.join(asked.select("query").distinct(), "query", "left_semi").unionByName(more)
    out = functools.reduce(DataFrame.unionByName, found)
    out = unbroadcast(out).join(unbroadcast(nodes.select("node", "name")), "node").select("query", F.col("name").alias("node"), "score")
    if far:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        for x in far:
            out = out.unionByName(ranked(both, seeds.join(x, "query", "left_semi"), restart))
    return top_ranked(out, k, digits)
