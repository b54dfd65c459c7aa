"""Symbols of source files, by windows over their lines: nothing here leaves the JVM but the line diff.

A declaration is a line that a pattern knows; what it belongs to and where it ends follow from the lines
around it: running sums give the depth of braces and the runs of decorators, the last container before a
line is its class, and the next declaration, or the end of the file, ends what stands before.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.plans.spread import unbroadcast
from lodestrata.runtime import ship

#: Words that no declaration is named by.
RESERVED = (
    "if", "else", "for", "while", "do", "switch", "return", "throw", "try", "catch", "const", "let", "var", "import", "export", "default", "new", "typeof", "instanceof",
    "await", "yield", "delete", "void", "in", "of", "case", "break", "continue",
)
#: Characters of a signature, and lines that a method is taken to have after its first.
SIGNATURE, METHOD_LINES = 120, 5
#: The patterns of declarations.
_PY_CLASS, _PY_DEF, _PY_CONST = r"^class\s+(\w+)\s*[\(:]", r"^(?:async\s+)?def\s+(\w+)\s*\(", r"^([A-Z][A-Z_0-9]+)\s*[=:]"
_PY_METHOD = r"^(\s{4,}|\t+)(?:async\s+)?def\s+(\w+)\s*\("
_TS = {
    "class": r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)",
    "interface": r"^(?:export\s+)?interface\s+(\w+)",
    "enum": r"^(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+(\w+)",
    "type": r"^(?:export\s+)?type\s+(\w+)\s*[=<]",
    "function": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)",
    "arrow": r"^(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>|\w+\s*=>|<)",
}
_TS_METHOD = r"^(\s{2,})(?:(?:public|private|protected|static|abstract|override|readonly|async)\s+)*(?:get\s+|set\s+)?(\w+)\s*(?:<[^(]*>)?\s*\("


def _so_far(*by: str):
    return Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)


def _next(value: Column, *by: str) -> Column:
    return F.lead(value).over(Window.partitionBy(*by).orderBy("line_no"))


def _indent(t: Column) -> Column:
    return F.length(F.regexp_extract(t, r"^(\s*)", 1))


def _next_top(value: Column) -> Column:
    """The value of the next declaration of the file that is no method: the last of those seen from the file's end."""
    back = Window.partitionBy("path").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col("kind") != "method", value), True).over(back)


def _sized(ls: DataFrame) -> DataFrame:
    """Lines with n_lines, their number in the file: the windows over files need no second pass over the lines for it."""
    return ls if "n_lines" in ls.columns else ls.withColumn("n_lines", F.max("line_no").over(Window.partitionBy("path")))


_OUT = ["path", "name", "kind", "parent", "start_line", "end_line", "signature", "decorators", "visibility", "is_async"]


def python_symbols(ls: DataFrame) -> DataFrame:
    """Classes, functions, constants and methods. Decorators right above a definition, blank and comment lines aside, belong to it and move its start up by their number."""
    t = F.regexp_replace("text", r"^\s+|\s+$", "")
    d = _sized(ls).select("path", "line_no", "n_lines", "text", t.alias("t")).where((F.col("t") != "") & ~F.col("t").startswith("#"))
    d = d.withColumn("indent", _indent(F.col("text"))).withColumn("deco", F.regexp_extract("t", r"^@(\w[\w.]*)", 1))
    d = d.withColumn("is_deco", F.col("deco") != "")
    # decorators and the first line behind them share the number of plain lines before them
    d = d.withColumn("run", F.sum((~F.col("is_deco")).cast("int")).over(_so_far("path")) - F.when(F.col("is_deco"), 0).otherwise(1))
    d = d.withColumn("above", F.collect_list(F.when(F.col("is_deco"), F.concat(F.lit("@"), F.col("deco")))).over(_so_far("path", "run")))
    d = d.where("not is_deco")
    top = F.col("indent") == 0
    name = lambda p: F.regexp_extract("t", p, 1)
    kind = F.when(top & (name(_PY_CLASS) != ""), "class").when(top & (name(_PY_DEF) != ""), "function").when(top & (name(_PY_CONST) != ""), "variable")
    d = d.withColumn("top", kind)
    d = d.withColumn("owner", F.last(F.when(F.col("top").isNotNull(), F.struct("top", name(_PY_CLASS).alias("name"))), True).over(_so_far("path")))
    # a constant or a function ends a class, and indented definitions after it are no methods of it
    method = F.col("text").rlike(_PY_METHOD) & (F.col("owner.top") == "class")
    s = d.withColumn("kind", F.when(F.col("top").isNotNull(), F.col("top")).when(method, "method")).where("kind is not null")
    s = s.withColumn("name", F.when(F.col("kind") == "class", name(_PY_CLASS)).when(F.col("kind") == "variable", name(_PY_CONST)).otherwise(name(_PY_DEF)))
    s = s.withColumn("start", F.col("line_no") - F.when(F.col("kind") == "variable", 0).otherwise(F.size("above")))
    s = s.withColumn("next_line", _next_top(F.col("line_no"))).withColumn("next_start", _next_top(F.col("start")))
    end = F.when(F.col("kind") == "variable", F.col("line_no")).when(F.col("kind") == "class", F.coalesce(F.col("next_line") - 1, F.col("n_lines"))).otherwise(F.coalesce(F.col("next_start") - 1, F.col("n_lines")))
    dunder = F.col("name").rlike("^__.*__$")
    seen = F.when(F.col("name").startswith("_") & ~dunder, "private").otherwise("public")
    end, parent = F.when(F.col("kind") == "method", F.col("line_no") + METHOD_LINES).otherwise(end), F.when(F.col("kind") == "method", F.col("owner.name"))
    return s.select("path", "name", "kind", parent.alias("parent"), F.col("start").alias("start_line"), end.alias("end_line"), F.left("t", F.lit(SIGNATURE)).alias("signature"), F.array_join(F.when(F.col("kind") == "variable", F.array().cast("array<string>")).otherwise(F.col("above")), ",").alias("decorators"), F.when(F.col("kind") == "method", seen).otherwise("default").alias("visibility"), F.col("t").startswith("async ").alias("is_async"))


def typescript_symbols(ls: DataFrame) -> DataFrame:
    """Classes, interfaces, enums, types, functions and methods. A container holds the lines up to the first that takes the braces back to the depth before it."""
    t = F.regexp_replace("text", r"^\s+|\s+$", "")
    code = F.regexp_replace("text", "//.*$", "")
    net = F.regexp_count(code, F.lit(r"\{")) - F.regexp_count(code, F.lit(r"\}"))
    d = _sized(ls).select("path", "line_no", "n_lines", "text", t.alias("t"), net.alias("net")).where("t <> ''")
    d = d.withColumn("depth", F.sum("net").over(_so_far("path"))).withColumn("comment", F.col("t").rlike(r"^(//|\*|/\*)"))
    found = F.lit(None).cast("struct<kind:string,name:string>")
    for k, p in reversed(_TS.items()):
        n = F.regexp_extract("t", p, 1)
        found = F.when((n != "") & ~n.isin(*RESERVED), F.struct(F.lit("function" if k == "arrow" else k).alias("kind"), n.alias("name"))).otherwise(found)
    # only lines of the top level that are no comments are asked for declarations
    d = d.withColumn("found", F.when(~F.col("text").rlike(r"^\s") & ~F.col("comment"), found)).withColumn("top", F.col("found.kind")).withColumn("top_name", F.col("found.name"))
    d = d.withColumn("holds", F.col("top").isin("class", "interface", "enum"))
    d = d.withColumn("owner", F.last(F.when(F.col("holds"), F.struct(F.col("line_no").alias("at"), (F.col("depth") - 1).alias("open"), F.col("top_name").alias("name"))), True).over(_so_far("path")))
    # inside an owner's lines, what stands behind the first that closes it is outside
    shut = (F.col("line_no") > F.col("owner.at")) & (F.col("depth") <= F.col("owner.open"))
    d = d.withColumn("closed", F.min(F.when(shut, F.col("line_no"))).over(Window.partitionBy("path", "owner.at")))
    inside = F.col("owner").isNotNull() & (F.col("line_no") > F.col("owner.at")) & (F.col("closed").isNull() | (F.col("line_no") < F.col("closed")))
    m = F.regexp_extract("text", _TS_METHOD, 2)
    before = F.substring_index("text", "(", 1)
    method = inside & ~F.col("comment") & (m != "") & ~m.isin(*RESERVED) & ~before.contains(".") & ~before.contains("=")
    d = d.withColumn("kind", F.when(F.col("top").isNotNull(), F.col("top")).when(method, "method")).where("kind is not null")
    d = d.withColumn("next_line", _next_top(F.col("line_no")))
    is_method = F.col("kind") == "method"
    end = F.when(is_method, F.col("line_no") + METHOD_LINES).otherwise(F.coalesce(F.when(F.col("holds"), F.col("closed")), F.col("next_line") - 1, F.col("n_lines")))
    return d.select("path", F.when(is_method, m).otherwise(F.col("top_name")).alias("name"), "kind", F.when(is_method, F.col("owner.name")).alias("parent"), F.col("line_no").alias("start_line"), end.alias("end_line"), F.left("t", F.lit(SIGNATURE)).alias("signature"), F.lit("").alias("decorators"), F.when(F.col("t").startswith("export"), "public").otherwise("default").alias("visibility"), F.col("t").rlike(r"\basync\b").alias("is_async"))


def symbols(files: DataFrame) -> DataFrame:
    """The symbol index of files (path, content): each language by its patterns."""
    every = F.split("content", "\n", -1)
    ls = files.select("path", F.size(every).cast("long").alias("n_lines"), F.posexplode(every).alias("i", "text")).select("path", (F.col("i") + 1).cast("long").alias("line_no"), "n_lines", "text")
    return python_symbols(ls.where(F.col("path").rlike(r"\.py$"))).unionByName(typescript_symbols(ls.where(F.col("path").rlike(r"\.(tsx?|jsx?|mjs)$"))))


def annotated(syms: DataFrame, name: str) -> DataFrame:
    """Symbols that bear a decorator of the name, without regard to case."""
    return syms.where(F.array_contains(F.split(F.lower("decorators"), ","), "@" + name.lower()))


def qualified(syms: DataFrame) -> DataFrame:
    return syms.withColumn("qualified_name", F.concat_ws(".", "parent", "name"))


def resolved(asked: DataFrame, syms: DataFrame) -> DataFrame:
    """(asked, path, start_line) of names (asked): a dotted name by its qualified name, else by its last part; of several the first in the files' order.

    Symbols are made once and brought down to the first of each name before names meet: no name's bearers meet all that ask for it.
    """
    q = qualified(syms).select(F.explode(F.array(F.struct(F.col("qualified_name").alias("_k"), F.lit(0).alias("rank")), F.struct(F.col("name").alias("_k"), F.lit(1).alias("rank")))).alias("n"), "path", "start_line")
    first = q.groupBy("n._k", "n.rank").agg(F.min(F.struct("path", "start_line")).alias("at"))
    a = asked.select("asked").distinct()
    a = a.select("asked", F.explode(F.array(F.struct(F.col("asked").alias("_k"), F.lit(0).alias("rank")), F.struct(F.substring_index("asked", ".", -1).alias("_k"), F.lit(1).alias("rank")))).alias("n")).select("asked", "n.*")
    best = unbroadcast(a).join(unbroadcast(first), ["_k", "rank"]).groupBy("asked").agg(F.min(F.struct("rank", "at")).alias("b"))
    return best.select("asked", "b.at.path", "b.at.start_line")


def references(files: DataFrame, syms: DataFrame) -> DataFrame:
    """Where names of the index stand: identifiers of each line joined to the index's names; lines that define are definitions, lines that import are imports."""
    from lodestrata.operators.text import lines

    words = lines(files).select("path", "line_no", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), 1))).alias("symbol"))
    names = syms.select(F.col("name").alias("symbol")).distinct()
    hit = words.join(names, "symbol")
    defs = syms.select(F.col("name").alias("symbol"), "path", F.col("signature").alias("s")).distinct()
    d = hit.join(defs, ["symbol", "path"], "left").withColumn("section", F.when(F.trim("text").startswith(F.col("s")), "definition").when(F.col("text").rlike(r"^\s*(import|from|export .* from)\b"), "import").otherwise("usage"))
    first = F.array_position(F.array(*map(F.lit, ("definition", "import", "usage"))), F.col("section"))
    return d.groupBy("symbol", "path", "line_no").agg(F.min_by("section", first).alias("section"))


def inferred_ends(syms: DataFrame, sizes: DataFrame) -> DataFrame:
    """End lines from the next sibling; the last of a file's top level ends with the file, the last of a parent ten lines on or with the file."""
    nxt = F.lead("start_line").over(Window.partitionBy("path", "parent").orderBy("start_line", "name"))
    last = F.when(F.col("parent").isNull(), F.col("n_lines")).otherwise(F.least(F.col("start_line") + 10, F.col("n_lines")))
    return syms.withColumn("next", nxt).join(sizes, "path").select("path", "parent", "name", "start_line", F.coalesce(F.col("next") - 1, last).alias("end_line"))


def read_symbol(syms: DataFrame, ls: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """Lines of each symbol with some around it: path is the equal key, the lines are a range under it."""
    s = syms.select("path", "name", F.greatest(F.lit(1), F.col("start_line") - before).alias("lo"), (F.col("end_line") + after).alias("hi"))
    return unbroadcast(s).join(unbroadcast(ls), "path").where(F.col("line_no").between(F.col("lo"), F.col("hi"))).select("path", "name", "line_no", "text")


def shown_lines(slices: DataFrame, whole: int = 300, head: int = 50, tail: int = 30) -> DataFrame:
    """Long symbols show their first and last lines."""
    w = Window.partitionBy("path", "name")
    d = slices.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy("line_no")))
    return d.where((F.col("n") <= whole) | (F.col("k") <= head) | (F.col("k") > F.col("n") - tail)).drop("n", "k")


def read_symbols(requests: DataFrame, syms: DataFrame) -> DataFrame:
    """Requested names (ord, path, name) with their ranges; of equal ranges the first request stays."""
    r = requests.join(syms.select("path", "name", "start_line", "end_line"), ["path", "name"])
    return r.groupBy("path", "start_line", "end_line").agg(F.min(F.struct("ord", "name")).alias("f")).select("path", "f.name", "f.ord", "start_line", "end_line")


def outline(syms: DataFrame, most: int = 40, children: int = 30) -> DataFrame:
    """Symbols in order, with caps for top levels and for the children of each."""
    w = Window.partitionBy("path", "parent").orderBy("start_line", "name")
    return syms.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= F.when(F.col("parent").isNull(), most).otherwise(children))


def exported(syms: DataFrame) -> DataFrame:
    return syms.where("visibility = 'public' and parent is null")


def http_routes(syms: DataFrame) -> DataFrame:
    """Routes from decorators of the form @get('/x') under the class's @controller('/p'); slashes are joined to one."""
    verb = F.lower(F.regexp_extract("decorator", r"@(Get|Post|Put|Patch|Delete|get|post|put|patch|delete)\(", 1))
    arg = F.regexp_extract("decorator", r"\(\s*['\"]([^'\"]*)['\"]", 1)
    m = syms.select("path", "name", "parent", F.explode("decorators").alias("decorator")).select("path", "name", "parent", verb.alias("verb"), arg.alias("arg"))
    base = m.where("parent is null and verb = ''").select("path", F.col("name").alias("parent"), F.col("arg").alias("base"))
    r = m.where("verb <> ''").join(base, ["path", "parent"], "left")
    full = F.regexp_replace(F.concat(F.lit("/"), F.coalesce("base", F.lit("")), F.lit("/"), F.col("arg")), "/+", "/")
    return r.select("path", "name", F.upper("verb").alias("verb"), F.when(F.length(full) > 1, F.regexp_replace(full, "/$", "")).otherwise(full).alias("route"))


def json_sections(ls: DataFrame) -> DataFrame:
    """Keys of the root object with their lines, in files of three lines or more. Strings are taken out before the brackets are counted."""
    bare = F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"', '""')
    net = F.regexp_count(bare, F.lit(r"[\[{]")) - F.regexp_count(bare, F.lit(r"[\]}]"))
    d = _sized(ls).withColumn("before", F.coalesce(F.sum(net).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = d.where("before = 1 and n_lines >= 3").select("path", "line_no", "n_lines", F.regexp_extract("text", r'^\s*"([^"]+)"\s*:', 1).alias("key")).where("key <> ''")
    return k.withColumn("next", _next(F.col("line_no"), "path")).select("path", "key", F.col("line_no").alias("start_line"), (F.coalesce("next", F.col("n_lines")) - 1).alias("end_line"))


def import_rows(ls: DataFrame) -> DataFrame:
    """Imports of a file: source, names, and their form."""
    t = F.trim("text")
    ts = F.regexp_extract(t, r"""^import\s+(?:type\s+)?(.*?)\s+from\s+['"]([^'"]+)['"]""", 2)
    what = F.regexp_extract(t, r"""^import\s+(?:type\s+)?(.*?)\s+from\s+['"]""", 1)
    py_from, py_what = F.regexp_extract(t, r"^from\s+(\S+)\s+import\s+(.+)$", 1), F.regexp_extract(t, r"^from\s+(\S+)\s+import\s+(.+)$", 2)
    bare = F.concat(F.regexp_extract(t, r"""^import\s+['"]([^'"]+)['"]""", 1), F.regexp_extract(t, r"^import\s+([\w.]+)(?:\s+as\s+\w+)?$", 1))
    d = ls.select("path", F.col("line_no").alias("line"), F.when(ts != "", ts).when(py_from != "", py_from).otherwise(bare).alias("source"), F.when(ts != "", what).when(py_from != "", py_what).otherwise(F.lit("")).alias("what"))
    names = F.filter(F.transform(F.split(F.regexp_replace("what", r"[{}()]", ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    return d.where("source <> ''").select("path", "line", "source", F.array_join(names, ",").alias("names"), F.col("what").startswith("*").alias("is_namespace"), (F.col("what").rlike(r"^\w") & ~F.col("source").rlike(r"^[\w.]+$")).alias("is_default"))


def pattern_search(ls: DataFrame, pattern: str, extension: str | None = None) -> DataFrame:
    """Lines that a regular expression finds; an approximation of a search by syntax tree."""
    d = ls.where(F.col("text").rlike(pattern))
    return d if extension is None else d.where(F.col("path").endswith(extension))


def _aligned(old: list[str], new: list[str]) -> list[tuple[str, str]]:
    """Old lines claim the next equal new line in turn; new lines passed over are added, old lines that find none are removed."""
    places: dict[str, list[int]] = {}
    for i, x in enumerate(new):
        places.setdefault(x, []).append(i)
    out, at = [], 0
    for x in old:
        mine = places.get(x, [])
        k = bisect_left(mine, at)
        if k == len(mine):
            out.append(("removed", x))
            continue
        out += [("added", y) for y in new[at : mine[k]]] + [("same", x)]
        at = mine[k] + 1
    return out + [("added", y) for y in new[at:]]


def _diffed(batches):
    for b in batches:
        rows = [(p, i, kind, text) for p, old, new in zip(*(b.column(c).to_pylist() for c in ("path", "old", "new")), strict=True) if old != new for i, (kind, text) in enumerate(_aligned((old or "").split("\n"), (new or "").split("\n"))) if kind != "same"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 4, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["path", "ord", "change", "text"])


def snapshot_diff(snapshots: DataFrame) -> DataFrame:
    """Line changes between two contents (path, old, new); equal contents have none."""
    ship(snapshots.sparkSession)
    d = snapshots.where(~F.col("old").eqNullSafe(F.col("new"))).select("path", "old", "new")
    return d.mapInArrow(_diffed, "path string, ord long, change string, text string")
