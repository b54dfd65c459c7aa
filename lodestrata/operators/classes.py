"""Methods of classes whose index knows their lines alone: a second pass over the files, by the indent of each class's body.

A class is an interval of its file's lines. The first definition inside gives the body's indent, and only
definitions of exactly that indent are methods; deeper ones are functions inside them. A file and its classes are one row, and
all of it happens inside: nothing is exploded before the methods are known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.plans.spread import unbroadcast

#: What makes a method of Python and of PHP, and the first definition of a body, which gives its indent.
PY_FIRST, PY_METHOD = r"^(\s+)def\s", r"^\s*def\s+(\w+)\s*\("
PHP_FIRST, PHP_METHOD = r"^(\s+)(?:public|private|protected|static|\s)*function\s", r"^\s*(?:(public|private|protected)\s+)?(?:(static)\s+)?function\s+(\w+)\s*\("
PY_DECORATOR = r"^\s*@(\w+)"


def _indent(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def _trailing(lines: Column, counts: Callable[[Column], Column]) -> Column:
    """How many of the last lines count, up to the first from the end that does not."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda a, x: F.struct(F.when(a["on"] & counts(x), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & counts(x)).alias("on"))
    return F.aggregate(F.reverse(lines), start, step)["n"]


def _starts(c: Column, lines: Column, first: str, method: str) -> Column:
    """struct(indent, at) of a class: its body's indent and the lines, from 1, on which its methods begin. Without a definition there are none."""
    last = F.least(c["end_line"], F.size(lines))
    inside = F.when(last > c["start_line"], F.sequence(c["start_line"] + 1, last)).otherwise(F.array().cast("array<bigint>"))
    line = lambda i: F.get(lines, (i - 1).cast("int"))
    indent = F.length(F.regexp_extract(line(F.get(F.filter(inside, lambda i: line(i).rlike(first)), F.lit(0))), first, 1))
    return F.struct(indent.alias("indent"), F.filter(inside, lambda i: line(i).rlike(method) & (_indent(line(i)) == indent)).alias("at"))


def _with_starts(files: DataFrame, classes: DataFrame, first: str, method: str) -> DataFrame:
    """A row for each class with methods: path, c, b (indent, at) and the lines of its file."""
    of = classes.groupBy("path").agg(F.collect_list(F.struct(F.col("name"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))).alias("cs"))
    d = unbroadcast(files).join(unbroadcast(of), "path").select("path", F.split(F.coalesce("content", F.lit("")), "\n", -1).alias("lines"), "cs")
    d = d.withColumn("found", F.transform("cs", lambda c: F.struct(c.alias("c"), _starts(c, F.col("lines"), first, method).alias("b"))))
    return d.select("path", "lines", F.explode(F.filter("found", lambda f: F.size(f["b"]["at"]) > 0)).alias("f")).select("path", "lines", F.col("f.c").alias("c"), F.col("f.b").alias("b"))


def python_methods(files: DataFrame, classes: DataFrame) -> DataFrame:
    """path, parent, name, kind, start_line, end_line, signature, visibility, is_async, is_static and decorators of the methods of classes (path, name, start_line, end_line).

    A definition behind `async` is none here, as the word stands where the indent ends. Blank lines and decorators before the next
    method are no part of a method; the last ends with its class. Double underscores at both ends are protected.
    """
    d = _with_starts(files, classes, PY_FIRST, PY_METHOD)
    line = lambda i: F.get("lines", (i - 1).cast("int"))
    indent = F.col("b.indent")
    decorator = lambda x: x.rlike(PY_DECORATOR) & (_indent(x) == indent)
    between = lambda lo, hi: F.slice("lines", (lo + 1).cast("int"), F.greatest((hi - lo - 1).cast("int"), F.lit(0)))  # noqa: E731  lines behind lo and before hi

    def method(i: Column, k: Column) -> Column:
        nxt = F.get("b.at", k + 1)
        name = F.regexp_extract(line(i), PY_METHOD, 1)
        above = between(F.col("c.start_line"), i)
        n = _trailing(above, decorator)
        spare = _trailing(between(i, nxt), lambda x: (F.trim(F.regexp_replace(x, r"\s+", " ")) == "") | decorator(x))
        before = line(i - 1)
        return F.struct(
            name.alias("name"), i.alias("start_line"), F.when(nxt.isNull(), F.col("c.end_line")).otherwise(nxt - 1 - spare).alias("end_line"),
            F.regexp_replace(line(i), r"^\s+|\s+$", "").alias("signature"), line(i).contains("async def").alias("is_async"),
            before.rlike(r"^\s*@staticmethod").alias("is_static"), before.rlike(r"^\s*@classmethod").alias("is_class"),
            F.transform(F.slice(above, F.size(above) - n + 1, n), lambda x: F.concat(F.lit("@"), F.regexp_extract(x, PY_DECORATOR, 1))).alias("decorators"),
        )

    m = d.select("path", F.col("c.name").alias("parent"), F.explode(F.transform("b.at", method)).alias("m")).select("path", "parent", "m.*")
    seen = F.when(F.col("name").startswith("__") & ~F.col("name").endswith("__"), "private").when(F.col("name").startswith("_"), "protected").otherwise("public")
    return m.select("path", "parent", "name", F.when(F.col("is_static") | F.col("is_class"), "function").otherwise("method").alias("kind"), "start_line", "end_line", "signature", seen.alias("visibility"), "is_async", "is_static", "decorators")


def php_methods(files: DataFrame, classes: DataFrame) -> DataFrame:
    """path, parent, name, kind, start_line, end_line, signature, visibility and is_static of the methods of PHP classes (path, name, start_line, end_line). A method ends before the next, the last with its class."""
    d = _with_starts(files, classes, PHP_FIRST, PHP_METHOD)
    line = lambda i: F.get("lines", (i - 1).cast("int"))

    def method(i: Column, k: Column) -> Column:
        nxt, of = F.get("b.at", k + 1), lambda g: F.regexp_extract(line(i), PHP_METHOD, g)
        return F.struct(of(3).alias("name"), i.alias("start_line"), F.when(nxt.isNull(), F.col("c.end_line")).otherwise(nxt - 1).alias("end_line"), F.regexp_replace(line(i), r"^\s+|\s+$", "").alias("signature"), F.when(of(1) == "", "public").otherwise(of(1)).alias("visibility"), (of(2) != "").alias("is_static"))

    m = d.select("path", F.col("c.name").alias("parent"), F.explode(F.transform("b.at", method)).alias("m")).select("path", "parent", "m.*")
    return m.select("path", "parent", "name", F.when(F.col("is_static"), "function").otherwise("method").alias("kind"), "start_line", "end_line", "signature", "visibility", "is_static")
