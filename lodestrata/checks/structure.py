"""Queries over symbols; the tables hold no source code, so every customer gets a project of a few files, whose names bear the customer's key."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.operators import classes as cl
from lodestrata.operators import patterns as pt
from lodestrata.operators import structure as st
from lodestrata.operators.text import lines
from lodestrata.plans.scratch import saved
from lodestrata.plans.spread import spread, unbroadcast
from lodestrata.sources.adapters import duck, per_customer, per_customer_sql, table, view

PY = '''"""Doc."""
import os
from pkg.db import Store, connect

LIMIT = 10

# a comment
@cache

@app.route("/x")
def load(path):
    return Store(path)


class Engine§(Base):
    size = 1

    def __init__(self):
        self.store = load("x")

    @property
    async def ready(self):
        return True

    def _hide(self): pass

async def main():
    Engine§()
'''
TS = """import { Store, Row } from './store';
import * as path from "path";
// class Ghost {
export class User extends Base {
  private name: string;
  constructor(name: string) {
    super(name);
  }
  async greet§(to: User): Promise<void> {
    if (to) {
      this.log(to);
    }
  }
  handler = (x) => x;
}
export interface Shape {
  area(): number;
}
export const enum Color { Red }
type Id = string;
export async function run(u: User) { return u.greet§(u); }
const add = (a, b) => a + b;
"""
JSON = '{\n  "name": "a{b",\n  "deep": {\n    "x": [1, 2],\n    "y": "q\\"}"\n  },\n  "last": 1\n}'
FILES = [("src/engine.py", PY), ("src/user.ts", TS), ("pkg/p.json", JSON), ("pkg/min.json", '{"a": 1}'), ("src/empty.py", "")]


def files(spark, sf):
    return per_customer(spark, sf, FILES, "path string, content string", ("path",))


def _symbols(spark, sf):
    return st.symbols(files(spark, sf))


_SYMBOLS = [
    ("src/engine.py", "LIMIT", "variable", None, 5, 5), ("src/engine.py", "load", "function", None, 9, 14), ("src/engine.py", "Engine§", "class", None, 15, 26),
    ("src/engine.py", "__init__", "method", "Engine§", 18, 23), ("src/engine.py", "ready", "method", "Engine§", 21, 27), ("src/engine.py", "_hide", "method", "Engine§", 25, 30), ("src/engine.py", "main", "function", None, 27, 29),
    ("src/user.ts", "User", "class", None, 4, 15), ("src/user.ts", "constructor", "method", "User", 6, 11), ("src/user.ts", "super", "method", "User", 7, 12), ("src/user.ts", "greet§", "method", "User", 9, 14), ("src/user.ts", "Shape", "interface", None, 16, 18), ("src/user.ts", "area", "method", "Shape", 17, 22),
    ("src/user.ts", "Color", "enum", None, 19, 19), ("src/user.ts", "Id", "type", None, 20, 20), ("src/user.ts", "run", "function", None, 21, 21), ("src/user.ts", "add", "function", None, 22, 23),
]


def _values(rows, names):
    lit = lambda v: "NULL" if v is None else f"{v}::BIGINT" if isinstance(v, int) and not isinstance(v, bool) else str(v) if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    values = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"
    cols = names.split(", ")
    return per_customer_sql(values, ", ".join(c for c in cols if c == "path"), "", ", ".join(c for c in cols if c in ("name", "parent", "text", "asked", "symbol", "source", "names", "decorators", "key", "route")))


query("p01_p02_symbols", _values(_SYMBOLS, "path, name, kind, parent, start_line, end_line"))(lambda s, d: _symbols(s, d).select("path", "name", "kind", "parent", "start_line", "end_line"))
MORE = [
    ("a.py", "class A\nclass B:\n\tdef tab(self): pass\n  def two(self): pass\nX = 1\nXY = 1\nXYZ: int = 2\nclass C(B):\n    async def four(self): pass\n"),
    ("b.ts", "class D {\n  do(x) {}\n  get size() {}\n  static async run<T>(a: T) {}\n  x = (1)\n}\nexport default function* gen() {}\nlet f: Fn = async (a) => a\nexport class if {}\n"),
]
_MORE = [
    ("a.py", "B", "class", None), ("a.py", "tab", "method", "B"), ("a.py", "XY", "variable", None), ("a.py", "XYZ", "variable", None), ("a.py", "C", "class", None), ("a.py", "four", "method", "C"),
    ("b.ts", "D", "class", None), ("b.ts", "size", "method", "D"), ("b.ts", "run", "method", "D"), ("b.ts", "gen", "function", None), ("b.ts", "f", "function", None),
]
query("p01_p02_declarations", _values(_MORE, "path, name, kind, parent"))(lambda s, d: st.symbols(per_customer(s, d, MORE, "path string, content string", ("path",))).select("path", "name", "kind", "parent"))
query("p02_decorators", _values([("src/engine.py", "load", "@cache,@app.route"), ("src/engine.py", "ready", "@property")], "path, name, decorators"))(lambda s, d: _symbols(s, d).where("decorators <> ''").select("path", "name", "decorators"))
query("x06_references", _values([("load", "src/engine.py", 11, "definition"), ("load", "src/engine.py", 19, "usage")], "symbol, path, line_no, section"))(lambda s, d: st.references(files(s, d), _symbols(s, d)).where("symbol = 'load'"))
query("x18_imports", _values([("src/engine.py", 2, "os", "", False, False), ("src/engine.py", 3, "pkg.db", "Store,connect", False, False), ("src/user.ts", 1, "./store", "Store,Row", False, False), ("src/user.ts", 2, "path", "* as path", True, False)], "path, line, source, names, is_namespace, is_default"))(lambda s, d: st.import_rows(lines(files(s, d))))
query("t02_read_symbol", _values([("src/user.ts", "Id", 20, "type Id = string;"), ("src/user.ts", "Id", 21, "export async function run(u: User) { return u.greet§(u); }")], "path, name, line_no, text"))(lambda s, d: st.read_symbol(_symbols(s, d).where("name = 'Id'"), lines(files(s, d)), 0, 1))
query("t03_read_symbols", _values([("src/user.ts", "Id", 1, 20, 20), ("src/user.ts", "run", 3, 21, 21)], "path, name, ord, start_line, end_line"))(lambda s, d: st.read_symbols(per_customer(s, d, [(1, "src/user.ts", "Id"), (2, "src/user.ts", "Id"), (3, "src/user.ts", "run")], "ord long, path string, name string", ("path",)), _symbols(s, d)))
query("p11_outline", _values([("src/engine.py", "Engine§", "__init__", 1)], "path, parent, name, ord"))(lambda s, d: st.outline(_symbols(s, d).where("path like '%engine.py' and parent is not null"), 40, 1).select("path", "parent", "name", F.col("ord").cast("long").alias("ord")))
query("j08_exports", _values([("src/user.ts", "User"), ("src/user.ts", "Shape"), ("src/user.ts", "Color"), ("src/user.ts", "run")], "path, name"))(lambda s, d: st.exported(_symbols(s, d)).select("path", "name"))
query("n03_json_sections", _values([("pkg/p.json", "name", 2, 2), ("pkg/p.json", "deep", 3, 6), ("pkg/p.json", "last", 7, 7)], "path, key, start_line, end_line"))(lambda s, d: st.json_sections(lines(files(s, d)).where("path like '%.json'")))
query("p12_http_routes", _values([("a.ts", "list", "GET", "/users"), ("a.ts", "one", "POST", "/users/x"), ("b.ts", "root", "GET", "/")], "path, name, verb, route"))(lambda s, d: st.http_routes(per_customer(s, d, [("a.ts", "Users§", None, ["@Controller('users/')"]), ("a.ts", "list", "Users§", ["@Get()"]), ("a.ts", "one", "Users§", ["@Auth()", "@Post('/x')"]), ("b.ts", "root", None, ["@get('/')"])], "path string, name string, parent string, decorators array<string>", ("path",))))
query("p03_inferred_ends", duck("symbols") + """, s AS (SELECT DISTINCT path, name, start_line FROM symbols), o AS (SELECT path, name, min(start_line) AS start_line FROM s GROUP BY path, name)
SELECT path, NULL::VARCHAR AS parent, name, start_line, coalesce(lead(start_line) OVER (PARTITION BY path ORDER BY start_line, name) - 1, 100) AS end_line FROM o""")(lambda s, d: _ends(s, d))


def _ends(spark, sf):
    sym = view(spark, sf, "symbols").groupBy("path", "name").agg(F.min("start_line").alias("start_line")).withColumn("parent", F.lit(None).cast("string"))
    nxt = sym.select("path").distinct().withColumn("n_lines", F.lit(100))
    return st.inferred_ends(sym, nxt)


query("x19_pattern_search", _values([("src/user.ts", 11, "      this.log(to);")], "path, line_no, text"))(lambda s, d: st.pattern_search(lines(files(s, d)), r"this\.\w+\(", ".ts"))
query("x21_annotated", _values([("src/engine.py", "ready")], "path, name"))(lambda s, d: st.annotated(_symbols(s, d), "property").select("path", "name"))
query("x21_deprecated", _values([("a.py", "old§"), ("a.py", "older")], "path, name"))(lambda s, d: st.annotated(st.symbols(per_customer(s, d, [("a.py", "@deprecated\ndef old§():\n  pass\n@x.y\n@Deprecated\ndef older():\n  pass\n@deprecated_soon\ndef other():\n  pass\n")], "path string, content string", ("path",))), "deprecated").select("path", "name"))
query("c05_snapshot_diff", _values([("a", 1, "removed", "2"), ("a", 3, "added", "x§"), ("b", 0, "removed", ""), ("b", 1, "added", "n")], "path, ord, change, text"))(lambda s, d: st.snapshot_diff(per_customer(s, d, [("a", "1\n2\n3\n4", "1\n3\nx§\n4"), ("b", "", "n"), ("c", "same", "same")], "path string, old string, new string", ("path",))))
query("b09_symbol_resolution", _values([("Engine§.ready", "src/engine.py", 21), ("greet§", "src/user.ts", 9)], "asked, path, start_line"))(lambda s, d: _resolved(s, d))


def _resolved(spark, sf):
    return st.resolved(per_customer(spark, sf, [("Engine§.ready",), ("greet§",), ("Nope.x",)], "asked string"), _symbols(spark, sf))


def _code_files(spark, sf):
    """A file of code for each order: its lines are an argument, one order in three calls something else, and a comment and a string hold calls that are none."""
    orders = table(spark, sf, "orders")
    n = orders.count()
    lines = spread(table(spark, sf, "lineitem"), "l_orderkey", rows=n).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda y: y["l_quantity"].cast("int").cast("string")), ", ").alias("args"))
    o = spread(orders, "o_orderkey", rows=n).join(unbroadcast(lines), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    call = F.when(F.col("o_orderkey") % 3 == 0, "sum").otherwise("total")
    text = F.concat(F.lit("// total(1)\nexport function o"), k, F.lit("() {\n  const t = "), call, F.lit("("), k, F.lit(", ["), F.coalesce("args", F.lit("")), F.lit("],\n    \"total(2)\", 'a)b');\n  if (t) { log("), call, F.lit("(t, "), c, F.lit(")) }\n}\n"))
    return o.select(F.concat(F.lit("src/o"), k, F.lit(".ts")).alias("path"), text.alias("content"))


def _structural(spark, sf):
    f = _code_files(spark, sf)
    index = saved(pt.word_index(f).repartition("word").sortWithinPartitions("word"), "words")
    d = pt.structural_search(f, index, "total($FIRST, $$$REST)")
    return d.select("path", "line", "end_line", F.col("bindings")["FIRST"].alias("first"), F.col("bindings")["REST"].alias("rest"))


query("x19_structural_search", """WITH l AS (SELECT l_orderkey, array_to_string(list(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) ORDER BY l_linenumber, l_quantity), ', ') AS args FROM lineitem GROUP BY 1)
SELECT 'src/o' || o_orderkey || '.ts' AS path, r.line AS line, r.end_line AS end_line, r.f AS first, r.r AS rest FROM (SELECT o_orderkey, unnest([{'line': 3::BIGINT, 'end_line': 4::BIGINT, 'f': o_orderkey::VARCHAR, 'r': '[' || coalesce(args, '') || '],' || chr(10) || '    "total(2)", ' || chr(39) || 'a)b' || chr(39)}, {'line': 5::BIGINT, 'end_line': 5::BIGINT, 'f': 't', 'r': o_custkey::VARCHAR}]) AS r FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0)""")(_structural)
query("x19_word_index", """WITH l AS (SELECT DISTINCT o_orderkey AS k FROM orders) SELECT word, count(*) AS n FROM (SELECT k, unnest(list_concat(['total', 'export', 'function', 'o' || k, 'const', 't', 'a', 'b', 'if', 'log'], CASE WHEN k % 3 = 0 THEN ['sum'] ELSE [] END)) AS word FROM l) GROUP BY word""")(lambda s, d: pt.word_index(_code_files(s, d)).groupBy("word").agg(F.count("*").alias("n")))


def _class_files(spark, sf, php):
    """A class for each order with a method for each of its lines; every third line is static, and each body holds a function that is no method."""
    n, p = F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")
    static = F.col("l_partkey") % 3 == 0
    if php:
        one = F.concat(F.lit("\n    "), F.when(static, "private static ").otherwise("public "), F.lit("function m"), n, F.lit("_"), p, F.lit("($a) {\n        $f = function inner"), n, F.lit("($b) {};\n    }"))
        head, tail = "<?php\nclass C extends B {\n    private $x;", "\n}"
    else:
        one = F.concat(F.when(static, "\n    @staticmethod").otherwise("\n\n    @cached"), F.lit("\n    def "), F.when(F.col("l_partkey") % 2 == 0, "_").otherwise(""), F.lit("m"), n, F.lit("_"), p, F.lit("(self):\n        def inner(): pass\n        return 1"))
        head, tail = "import os\nclass C(B):\n    x = 1", "\nz = 1"
    n_files = table(spark, sf, "orders").count()
    per = spread(table(spark, sf, "lineitem"), "l_orderkey", rows=n_files).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", one.alias("t")))), lambda y: y["t"]), "").alias("t"), F.count("*").alias("m"), F.count_if(~static).alias("blank"))
    files = per.select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("path"), F.concat(F.lit(head), F.col("t"), F.lit(tail)).alias("content"))
    end = 4 + 3 * F.col("m") if php else 3 + 4 * F.col("m") + F.col("blank")
    classes = per.select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("path"), F.lit("C").alias("name"), F.lit(2).alias("start_line"), end.alias("end_line"))
    return spread(files, "path", rows=n_files), spread(classes, "path", rows=n_files)


CLASS_LINES = "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS m, sum(CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE 1 END) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING))"
query("p04_python_methods", CLASS_LINES + """ SELECT 'c' || k AS path, 'C' AS parent, CASE WHEN p % 2 = 0 THEN '_' ELSE '' END || 'm' || n || '_' || p AS name, CASE WHEN p % 3 = 0 THEN 'function' ELSE 'method' END AS kind, CAST(4 * i + 1 + b AS BIGINT) AS start_line, CAST(4 * i + 3 + b AS BIGINT) AS end_line,
CASE WHEN p % 2 = 0 THEN 'protected' ELSE 'public' END AS visibility, p % 3 = 0 AS is_static, CASE WHEN p % 3 = 0 THEN '@staticmethod' ELSE '@cached' END AS decorators FROM l""")(lambda s, d: cl.python_methods(*_class_files(s, d, False)).select("path", "parent", "name", "kind", "start_line", "end_line", "visibility", "is_static", F.array_join("decorators", ",").alias("decorators")))
query("p05_php_methods", CLASS_LINES + """ SELECT 'c' || k AS path, 'C' AS parent, 'm' || n || '_' || p AS name, CASE WHEN p % 3 = 0 THEN 'function' ELSE 'method' END AS kind, CAST(3 * i + 1 AS BIGINT) AS start_line, CAST(CASE WHEN i = m THEN 3 * i + 4 ELSE 3 * i + 3 END AS BIGINT) AS end_line,
CASE WHEN p % 3 = 0 THEN 'private static ' ELSE 'public ' END || 'function m' || n || '_' || p || '($a) {' AS signature, CASE WHEN p % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, p % 3 = 0 AS is_static FROM l""")(lambda s, d: cl.php_methods(*_class_files(s, d, True)))
