"""What a project is made of: its tools, how its files import each other, who extends whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.exprs import token_estimate
from lodestrata.plans.ranges import overlap_join
from lodestrata.plans.spread import unbroadcast

#: Endings that an import may leave out, in the order in which they are tried.
ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".php", ".go", ".rs", ".java", ".kt", ".swift"]
#: The files that tell of a tool, a pipeline or containers.
QUALITY = {
    "PHPStan": ["phpstan.neon", "phpstan.neon.dist"], "Psalm": ["psalm.xml", "psalm.xml.dist"], "PHPUnit": ["phpunit.xml", "phpunit.xml.dist"], "Pest": ["pest.php"],
    "ESLint": [".eslintrc", ".eslintrc.js", ".eslintrc.json", ".eslintrc.yml", "eslint.config.js", "eslint.config.mjs"], "TypeScript": ["tsconfig.json"],
    "Vitest": ["vitest.config.ts", "vitest.config.js", "vitest.config.mts"], "Jest": ["jest.config.js", "jest.config.ts", "jest.config.mjs"], "Biome": ["biome.json", "biome.jsonc"],
    "Prettier": [".prettierrc", ".prettierrc.js", ".prettierrc.json", "prettier.config.js"], "Deptrac": ["deptrac.yaml", "deptrac.yml"], "Rector": ["rector.php"], "Ruff": ["ruff.toml", ".ruff.toml"],
}
PIPELINES = {"GitLab CI": [".gitlab-ci.yml"], "Jenkins": ["Jenkinsfile"], "CircleCI": [".circleci/config.yml"], "Bitbucket Pipelines": ["bitbucket-pipelines.yml"], "Travis CI": [".travis.yml"]}
CONTAINERS = {"Docker": ["Dockerfile", "docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"]}


def _named(path: Column, tools: dict[str, list[str]]) -> Column:
    c = F.lit(None).cast("string")
    for name, files in tools.items():
        c = F.when(path.isin(files), name).otherwise(c)
    return c


def tooling(files: DataFrame) -> DataFrame:
    """(section, name, n) of quality tools, pipelines and containers, by the files (path, content) of a project; n counts workflows, and is 1 for all others.

    The linter that may be set up inside a Python project's manifest is looked for there, too.
    """
    path = F.col("path")
    ruff = (path == "pyproject.toml") & F.col("content").contains("[tool.ruff]")
    quality = F.when(ruff, "Ruff").otherwise(_named(path, QUALITY))
    workflow = path.rlike(r"^\.github/workflows/[^/]+\.ya?ml$")
    pipeline = F.when(workflow, "GitHub Actions").otherwise(_named(path, PIPELINES))
    docker = _named(path, CONTAINERS)
    section = F.when(quality.isNotNull(), "quality").when(pipeline.isNotNull(), "ci").when(docker.isNotNull(), "docker")
    found = files.select(section.alias("section"), F.coalesce(quality, pipeline, docker).alias("name"), workflow.alias("counts")).where("section is not null")
    return found.groupBy("section", "name").agg(F.greatest(F.count_if("counts"), F.lit(1)).cast("long").alias("n"))


def stack_confidence(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """(project, confidence): how far what the index says (project, type) agrees with the stacks that manifests tell of (project, type)."""
    low = F.lower("type").alias("t")
    stacks = found.select("project", low).distinct()
    says = indexed.select("project", F.lower("type").alias("says"))
    a, t = F.col("says"), F.col("t")
    alike = a.contains(t) | t.contains(a) | ((a.contains("javascript") | a.contains("typescript")) & t.contains("node")) | (a.contains("php") & (t == "php"))
    g = says.join(stacks, "project", "full").groupBy("project").agg(F.max("says").alias("says"), F.count("t").alias("n"), F.bool_or(alike).alias("alike"))
    level = F.when(F.col("says").isNull() & (F.col("n") == 0), "unknown").when(F.col("says").isNull() | (F.col("n") == 0), "medium")
    level = level.when(F.col("alike") & (F.col("n") == 1), "high").when(F.col("alike"), "medium").otherwise("low")
    return g.select("project", level.alias("confidence"))


def normal_path(path: Column) -> Column:
    """A path without empty parts, . and ..; null if it leaves the project."""
    none = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(x.isin("", "."), acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(?:(.*)/)?[^/]*$", 1)


def resolved_imports(imports: DataFrame, files: DataFrame, folders: bool = True) -> DataFrame:
    """(path, source, target) of imports (path, source) that lead to a file or folder of the project.

    Tried are the path itself, then with each ending, and as a folder's index file. Each file says by which names it
    may be imported, three at most, so that an import needs one row and not one for each candidate.
    """
    p = F.col("path")
    names = [F.struct(p.alias("base"), F.lit(0).alias("ord"), p.alias("target"))]
    for i, end in enumerate(ENDINGS):
        cut = p.substr(F.lit(1), F.length(p) - len(end))
        names.append(F.when(p.endswith(end), F.struct(cut.alias("base"), F.lit(2 * i + 1).alias("ord"), p.alias("target"))))
        names.append(F.when((F.substring_index(p, "/", -1) == f"index{end}"), F.struct(folder_of(p).alias("base"), F.lit(2 * i + 2).alias("ord"), p.alias("target"))))
    known = files.select(F.explode(F.array_compact(F.array(*names))).alias("x")).select("x.*")
    if folders:
        parts = F.split("path", "/")
        each = files.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("base")).distinct()
        known = known.unionByName(each.select("base", F.lit(0).alias("ord"), F.col("base").alias("target")))
    s = F.col("source")
    asked = imports.select("path", "source").distinct().where(s.startswith(".") | s.startswith("/"))
    asked = asked.withColumn("base", normal_path(F.when(s.startswith("/"), s).otherwise(F.concat(folder_of(p), F.lit("/"), s))))
    return unbroadcast(asked).join(unbroadcast(known), "base").groupBy("path", "source").agg(F.min_by("target", "ord").alias("target"))


def paths_match(a: Column, b: Column) -> Column:
    """Two paths of one file: one ends with the other."""
    return a.endswith(b) | b.endswith(a)


def matching_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of the paths a of left and b of right that match: each side's ends meet the other side's paths by equality, not every pair."""
    a, b = left.select(F.col("path").alias("a")).distinct(), right.select(F.col("path").alias("b")).distinct()
    ends = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.col(c).substr(i, F.length(c)))).alias("end")
    x = unbroadcast(a.select("a", ends("a"))).join(unbroadcast(b), F.col("end") == F.col("b")).select("a", "b")
    y = unbroadcast(b.select("b", ends("b"))).join(unbroadcast(a), F.col("end") == F.col("a")).select("a", "b")
    return x.unionByName(y).distinct()


def with_decorators(unused: DataFrame, syms: DataFrame) -> DataFrame:
    """unused (path, name, line) with the decorators of the symbol of that name that the line is in.

    In order of places the first symbol counts that bears any or stands at the top; its decorators may be none.
    """
    asked = unused.select("path", "name", "line").distinct()
    spans = syms.select("path", "name", "start_line", "end_line", F.coalesce("decorators", F.lit("")).alias("decorators"), F.col("parent").isNull().alias("top"))
    hit = overlap_join(asked, spans, ["path", "name"], ("line", "line"), ("start_line", "end_line"))
    first = hit.where("top or decorators <> ''").groupBy("path", "name", "line").agg(F.min_by("decorators", F.struct("start_line", -F.col("end_line"))).alias("decorators"))
    return asked.join(first, ["path", "name", "line"], "left").withColumn("decorators", F.coalesce("decorators", F.lit("")))


def heritage(ls: DataFrame) -> DataFrame:
    """(path, line, name, parent, kind) of classes and interfaces that extend or implement others, by lines (path, line_no, text)."""
    t = F.col("text")
    bare = F.regexp_replace(F.regexp_replace(t, "<[^<>]*>", ""), "<[^<>]*>", "")
    head = r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface)\s+(\w+)"
    up = lambda word: F.regexp_extract(bare, rf"\s{word}\s+([\w$.,\s]+?)\s*(?:\bimplements\b.*)?(?:\{{|$)", 1)
    python = r"^\s*class\s+(\w+)\s*\(([^)]*)\)\s*:"
    py = F.col("path").endswith(".py")
    name = F.when(py, F.regexp_extract(t, python, 1)).otherwise(F.regexp_extract(bare, head, 1))
    of = F.when(py, F.regexp_extract(t, python, 2)).otherwise(up("extends"))
    kinds = F.array(F.struct(F.lit("extends").alias("kind"), of.alias("names")), F.struct(F.lit("implements").alias("kind"), F.when(py, "").otherwise(up("implements")).alias("names")))
    d = ls.select("path", F.col("line_no").alias("line"), name.alias("name"), F.explode(kinds).alias("k")).where("name <> ''")
    d = d.select("path", "line", "name", "k.kind", F.explode(F.split("k.names", ",")).alias("parent")).withColumn("parent", F.trim("parent"))
    return d.where("parent <> '' and not contains(parent, '=')").select("path", "line", "name", "parent", "kind")


def implementations(edges: DataFrame, name: str) -> DataFrame:
    """(name, path, line) of what implements or extends a name."""
    return edges.where(F.col("parent") == name).select("name", "path", "line").distinct()


def hierarchy(edges: DataFrame, name: str) -> DataFrame:
    """(section, name, kind, path, line): the parents of a name and its children."""
    up = edges.where(F.col("name") == name).select(F.lit("parent").alias("section"), F.col("parent").alias("name"), "kind", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("line"))
    down = edges.where(F.col("parent") == name).select(F.lit("child").alias("section"), "name", "kind", "path", F.col("line").cast("long").alias("line"))
    return up.distinct().unionByName(down.distinct())


def capped_diff(parsed: DataFrame, diffs: DataFrame, symbols: DataFrame | None = None, most_files: int = 50, small: int = 30, most_lines: int = 500) -> DataFrame:
    """(diff_id, file_no, path, hunk_lines, inlined, shown) of the files of a diff's report.

    The first files are in it; hunks of few lines are shown whole, others as their number; a file is shown as long as
    the lines before it are not too many. symbols: (diff_id, path, n) changed symbols, a line each, which the report also
    lists once at its top.
    """
    body = parsed.where("hunk_no > 0").where(F.col("text").rlike(r"^(\+(?!\+\+)|-(?!--)| )"))
    n = body.groupBy("diff_id", "file_no").agg(F.count("*").alias("hunk_lines"), F.count_distinct("hunk_no").alias("hunks"))
    d = diffs.select("diff_id", "file_no", "path", "is_binary").join(n, ["diff_id", "file_no"], "left").fillna(0, ["hunk_lines", "hunks"])
    d = d.join(symbols.select("diff_id", "path", F.col("n").alias("syms")), ["diff_id", "path"], "left") if symbols is not None else d.withColumn("syms", F.lit(None).cast("long"))
    d = d.withColumn("syms", F.coalesce("syms", F.lit(0)))
    whole = Window.partitionBy("diff_id")
    d = d.withColumn("_n", F.row_number().over(whole.orderBy("file_no"))).where(F.col("_n") <= most_files)
    inlined = ~F.col("is_binary") & F.col("hunk_lines").between(1, small)
    size = F.when(F.col("is_binary"), F.lit(2)).otherwise(2 + F.col("syms") + F.when(inlined, F.col("hunks") + F.col("hunk_lines")).when(F.col("hunk_lines") > small, F.lit(1)).otherwise(F.lit(0)))
    total = F.sum("syms").over(whole)
    before = F.coalesce(F.sum(size).over(whole.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = 2 + F.when(total > 0, total + 2).otherwise(F.lit(0)) + before
    return d.select("diff_id", "file_no", "path", "hunk_lines", inlined.alias("inlined"), (at < most_lines).alias("shown"))


def fingerprint(overview: Column) -> Column:
    """What the text of an overview says, as a struct: type, frameworks, files, patterns, architecture, modules, entry points."""
    one = lambda p: F.nullif(F.trim(F.regexp_extract(overview, p, 1)), F.lit(""))
    listed = lambda p: F.filter(F.transform(F.split(F.coalesce(one(p), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    entries = F.regexp_extract_all(overview, F.lit(r"(?m)^\s{2}(\S+).*\(\d+ files"), F.lit(1))
    return F.struct(
        one(r"TYPE[ \t]*(?:\([^)]*\))?:[ \t]*(.+)").alias("project_type"), listed("FRAMEWORKS:[ \\t]*(.+)").alias("frameworks"),
        F.coalesce(F.nullif(F.regexp_extract(overview, r"(\d+)\s*files", 1), F.lit("")).cast("long"), F.lit(0)).alias("files"),
        listed("PATTERNS:[ \\t]*(.+)").alias("patterns"), one("ARCHITECTURE:[ \\t]*(.+)").alias("architecture"),
        F.size(entries).cast("long").alias("modules"), F.filter(entries, lambda x: x.rlike("^(src|lib|app|main|index)")).alias("entrypoints"),
    )


def denial(head: Column, signals: Column, note: Column, foot: Column, most: int = 1200, advice: str = "(trimmed to fit budget)") -> Column:
    """The text of a refused read: what a file holds, in sections, within a budget of tokens.

    signals: array of struct (kind, line, text). Over the budget a tenth of them goes, one at least, the last of the last
    section first, until the text fits or none is left: the sections' order makes what is kept a prefix.
    """
    kinds = [("import", "=== Imports ==="), ("export", "=== Exports / Public symbols ==="), (None, "=== Declarations ==="), ("raw", "=== Content preview (head + tail) ===")]
    of = lambda s, k: F.filter(s, lambda x: (x["kind"] == k) if k else ~x["kind"].isin("import", "export", "raw"))
    held = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  f of x, which is worked out once

    def body(every: Column, n: Column) -> Column:
        return held(F.slice(every, F.lit(1), n), sections)

    def sections(kept: Column) -> Column:
        parts = [F.when(note.isNotNull() & (note != ""), F.concat(F.lit("Note: "), note, F.lit("\n\n"))).otherwise(F.lit(""))]
        for k, title in kinds:
            s = of(kept, k)
            rows = F.array_join(F.transform(s, lambda x: F.concat(F.lit("L"), x["line"].cast("string"), F.lit(": "), x["text"])), "\n")
            parts.append(F.when(F.size(s) > 0, F.concat(F.lit(title + "\n"), rows, F.lit("\n\n"))).otherwise(F.lit("")))
        return F.regexp_replace(F.concat(*parts), r"\n\z", "")

    def fitted(every: Column) -> Column:
        text = lambda n: F.concat(head, F.lit("\n\n"), body(every, n), F.lit("\n"), foot)
        fits = lambda n: held(text(n), lambda x: token_estimate(x) <= most)
        # a tenth less in each round: no array is long enough to need more rounds
        step = lambda n, _: F.when((n == 0) | fits(n), n).otherwise(n - F.greatest(F.lit(1), F.floor(n * 0.1).cast("int")))
        kept = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(F.size(every), F.lit(1)), F.lit(400))), F.size(every), step)
        short = lambda n: F.concat(head, F.lit("\n\n"), F.regexp_replace(body(every, n), r"\s+$", ""), F.lit(f"\n\n{advice}\n\n"), foot)
        return held(kept, lambda n: F.when(n == F.size(every), text(n)).otherwise(short(n)))

    return held(F.concat(*[of(signals, k) for k, _ in kinds]), fitted)
