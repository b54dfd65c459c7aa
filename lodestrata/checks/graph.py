"""Queries over references, callers and modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.operators import fuzzy as fz
from lodestrata.operators import graph as g
from lodestrata.plans.scratch import saved
from lodestrata.sources.adapters import duck, per_customer, per_customer_sql, table, view

REFS, DEPS = duck("refs"), duck("module_deps")
RANKED = "row_number() OVER (PARTITION BY symbol, section ORDER BY path, line)"


def _refs(spark, sf):
    return view(spark, sf, "refs").drop("flag")


def _deps(spark, sf):
    return view(spark, sf, "module_deps")


def _hits(spark, sf):
    """Search hits over lineitem: one per order line, with a text that names a part."""
    t = table(spark, sf, "lineitem")
    return t.select(F.concat(F.lit("src"), (F.col("l_orderkey") % 7).cast("string"), F.lit("/o"), F.col("l_orderkey").cast("string"), F.when(F.col("l_orderkey") % 3 == 0, ".py").when(F.col("l_orderkey") % 3 == 1, ".ts").otherwise(".go")).alias("path"), F.col("l_linenumber").alias("line"), F.concat(F.when(F.col("l_returnflag") == "R", "import s").otherwise(F.lit("x=s")), (F.col("l_partkey") % 50).cast("string"), F.when(F.col("l_linestatus") == "F", "_a").otherwise(F.lit("("))).alias("text")).distinct()


HITS = """, hits AS (SELECT DISTINCT concat('src', l_orderkey % 7, '/o', l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END) AS path, l_linenumber AS line,
 concat(CASE WHEN l_returnflag = 'R' THEN 'import s' ELSE 'x=s' END, l_partkey % 50, CASE WHEN l_linestatus = 'F' THEN '_a' ELSE '(' END) AS text FROM lineitem)"""

query("b01_refs", f"{REFS} SELECT symbol, path, line, section FROM (SELECT *, {RANKED} AS n FROM refs) q WHERE n <= 20")(lambda s, d: g.usages(_refs(s, d), limit=20))
query("b02_callers", f"""{REFS}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, line) AS n FROM refs), u AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY path, line) AS m FROM f WHERE n <= 10 AND section = 'usage')
SELECT symbol, path, line FROM u WHERE m <= 5""")(lambda s, d: g.callers(_refs(s, d)))
query("b03_merge_hits", f"""{REFS}{HITS}, r AS (SELECT path, line, section FROM refs WHERE symbol = 's7')
SELECT path, line, section FROM r UNION ALL SELECT path, line, CASE WHEN regexp_matches(text, '\\bimport\\b') THEN 'import' ELSE 'usage' END FROM hits h
WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])s7($|[^A-Za-z0-9_])') AND NOT EXISTS (SELECT 1 FROM r WHERE r.path = h.path AND r.line = h.line)""")(lambda s, d: g.merge_hits(_refs(s, d).where("symbol = 's7'"), _hits(s, d), "s7"))
query("b04_section_routing", f"{REFS}{HITS} SELECT CASE WHEN regexp_matches(text, '\\bimport\\b') THEN 'import' ELSE 'usage' END AS section, count(*) AS n FROM hits GROUP BY 1")(lambda s, d: _hits(s, d).groupBy(g.section_of_hit(F.col("text")).alias("section")).agg(F.count("*").alias("n")))
query("b05_filtered_usages", f"{REFS} SELECT symbol, path, line, section FROM (SELECT *, {RANKED} AS n FROM refs WHERE contains(path, 'rc3/') AND suffix(path, '.py') AND section = 'usage') q WHERE n <= 3".replace("suffix(", "ends_with("))(lambda s, d: g.usages(_refs(s, d), "rc3/", "python", "usage", 3))
query("t09_usage_counts", f"""{REFS}, q AS (SELECT * FROM (SELECT *, {RANKED} AS n FROM refs) x WHERE n <= 5)
SELECT symbol, count(*) FILTER (section = 'definition') AS n_definition, count(*) FILTER (section = 'import') AS n_import, count(*) FILTER (section = 'usage') AS n_usage, count(*) AS total FROM q GROUP BY symbol""")(lambda s, d: g.usage_counts(g.usages(_refs(s, d), limit=5)))
query("b06_usage_list", f"{REFS} SELECT symbol, path, string_agg(DISTINCT line::VARCHAR, ',' ORDER BY line::VARCHAR) AS lines FROM refs GROUP BY symbol, path")(lambda s, d: g.usage_list(_refs(s, d)))
query("b07_context_lines", duck("files") + """, lines AS (SELECT path, i AS line_no, l[i] AS text FROM (SELECT path, string_split(content, chr(10)) AS l FROM files) f, unnest(range(1, len(l) + 1)) r(i))
SELECT l.path, 2::BIGINT AS hit, line_no, text FROM lines l WHERE line_no BETWEEN 1 AND 3""")(lambda s, d: g.context_lines(view(s, d, "files").select("path", F.lit(2).cast("long").alias("line")), _file_lines(s, d), 1))


def _file_lines(spark, sf):
    from lodestrata.operators.text import lines

    return lines(view(spark, sf, "files"))


query("b08_affected_files", f"{REFS} SELECT DISTINCT path FROM refs WHERE symbol IN ('s1', 's2')")(lambda s, d: g.affected_files(_refs(s, d).where("symbol in ('s1', 's2')")))
query("p13_scope_is_part", f"{REFS} SELECT count(*) AS n FROM refs WHERE contains(path, 'o12')")(lambda s, d: g.usages(_refs(s, d), "o12", limit=10**9).agg(F.count("*").alias("n")))
TESTS = [
    ("tests/a.py", False), ("src/tests/a.py", True), ("src/test/a.py", True), ("src/a.test.ts", True), ("src/a.spec.ts", True), ("a_test.go", True), ("test_x.py", True), ("contest_x.py", True),
    ("__tests__/a.js", True), ("src/testing.py", False), ("contest/a.py", False), ("spec/a.rb", False),
]
query("p16_test_paths", per_customer_sql(f"SELECT * FROM (VALUES {', '.join(f'({i}, {p!r}, {t})' for i, (p, t) in enumerate(TESTS))}) t(id, path, is_test)", "", "id"))(lambda s, d: per_customer(s, d, [(i, p) for i, (p, _) in enumerate(TESTS)], "id int, path string", (), ("id",)).withColumn("is_test", F.col("path").rlike(g.TEST_PATH)))
IMPORTS = "imports AS (SELECT r.path, d.path AS source FROM refs r JOIN refs d ON d.symbol = r.symbol AND d.section = 'definition' WHERE r.section = 'import')"
query("b10_related_files", f"""{REFS}, {IMPORTS}, t AS (SELECT path, string_split(path, '/')[1] AS dir, regexp_extract(path, '([^/]*)\\.\\w+$', 1) AS base, string_split(path, '.')[-1] AS lang FROM refs WHERE section = 'definition' GROUP BY path ORDER BY count(*) DESC, path LIMIT 1),
names AS (SELECT symbol FROM (SELECT symbol FROM refs WHERE section = 'definition' AND path = (SELECT path FROM t) ORDER BY line, symbol LIMIT 10) UNION SELECT base FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY symbol, section ORDER BY path, line) AS n FROM refs WHERE section <> 'definition' AND symbol IN (SELECT symbol FROM names)),
usr AS (SELECT path, count(*) AS n FROM f WHERE n <= 30 AND path <> (SELECT path FROM t) AND string_split(path, '.')[-1] = (SELECT lang FROM t) GROUP BY path),
imp AS (SELECT source AS path FROM imports WHERE path = (SELECT path FROM t) AND source <> path),
ev AS (SELECT path, 4 AS score, 'import' AS tag FROM imp UNION ALL SELECT path, 2, 'same-dir' FROM imp WHERE string_split(path, '/')[1] = (SELECT dir FROM t)
  UNION ALL SELECT path, 3, 'importer' FROM usr UNION ALL SELECT path, 2, 'same-dir' FROM usr WHERE string_split(path, '/')[1] = (SELECT dir FROM t) UNION ALL SELECT path, n - 1, 'multi-ref' FROM usr WHERE n > 1
  UNION ALL SELECT path, 5, 'test' FROM (SELECT DISTINCT replace(path, '.', '_test.') AS path FROM refs) WHERE contains(string_split(path, '/')[-1], (SELECT base FROM t))),
al AS (SELECT * FROM ev UNION ALL SELECT DISTINCT path, 2, 'changed' FROM ev WHERE path LIKE '%7.py')
SELECT path, CAST(sum(score) AS BIGINT) AS score, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, CASE WHEN sum(score) >= 5 THEN 'high' WHEN sum(score) >= 3 THEN 'medium' ELSE 'low' END AS bucket FROM al GROUP BY path""")(lambda s, d: _related(s, d))


def _related(spark, sf):
    """The tables name no test files: each file stands for a test of its own, too."""
    refs = saved(_refs(spark, sf), "refs")
    target = refs.where("section = 'definition'").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").first()["path"]
    defs = refs.where("section = 'definition'").select("symbol", F.col("path").alias("source"))
    imports = refs.where("section = 'import'").join(defs, "symbol").select("path", "source")
    files = refs.select(F.replace("path", F.lit("."), F.lit("_test.")).alias("path")).distinct()
    return g.related_files(refs, imports, files, target, refs.where("path like '%7.py'").select("path"))


def _recursive(body: str) -> str:
    return DEPS.replace("WITH ", "WITH RECURSIVE ", 1) + body


def _routes(start: int, goal: int, depth: int, kind: str = "") -> str:
    return _recursive(f""", r(node, path, depth) AS (SELECT {start}::BIGINT, '>{start}>', 0 UNION ALL SELECT e.dep::BIGINT, concat(r.path, e.dep::VARCHAR, '>'), r.depth + 1 FROM r JOIN module_deps e ON e.module = r.node
WHERE r.depth < {depth} AND r.node <> {goal} {kind} AND NOT contains(r.path, concat('>', e.dep::VARCHAR, '>'))) SELECT path, depth FROM r WHERE node = {goal} AND depth > 0 ORDER BY depth, path LIMIT 50""")


# every module depends on nearly every other: routes of three edges are thousands
query("b16_module_route", _routes(0, 14, 3))(lambda s, d: g.routes(s, _deps(s, d), 0, 14, 3))
query("b16_module_route_by_kind", _routes(1, 14, 3, "AND e.kind = 'api'"))(lambda s, d: g.routes(s, _deps(s, d), 1, 14, 3, kind="api"))
query("b11_call_tree", _recursive(""", r(node, path, depth) AS (SELECT 14::BIGINT, '>14>', 0 UNION ALL SELECT e.module::BIGINT, concat(r.path, e.module::VARCHAR, '>'), r.depth + 1 FROM r JOIN module_deps e ON e.dep = r.node
WHERE r.depth < 3 AND NOT contains(r.path, concat('>', e.module::VARCHAR, '>'))) SELECT node, path, depth FROM r WHERE depth > 0"""))(lambda s, d: g.call_tree(s, _deps(s, d), 14, 3))
query("x24_transitive_deps", _recursive(""", r(node, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dep::BIGINT, r.depth + 1 FROM r JOIN module_deps e ON e.module = r.node WHERE r.depth < 20)
SELECT node, min(depth) AS depth FROM r WHERE node <> 0 GROUP BY node"""))(lambda s, d: g.transitive(s, _deps(s, d), 0))
query("b15_module_info", f"{DEPS} SELECT 'dependency' AS role, dep AS other, kind FROM module_deps WHERE module = 5 UNION ALL SELECT 'dependent', module, kind FROM module_deps WHERE dep = 5")(lambda s, d: g.module_info(_deps(s, d), 5))
query("x26_unused_deps", f"{DEPS} SELECT module, dep FROM module_deps WHERE NOT (n % 3 = 0)")(lambda s, d: g.unused_deps(_deps(s, d), _deps(s, d).where("n % 3 = 0").select("module", "dep")))
query("b12_unused_symbols", "SELECT p_partkey AS id, 's' || p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= '1998-01-01')")(lambda s, d: g.unused(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("name")), table(s, d, "lineitem").where("l_returnflag = 'R' and l_shipdate >= '1998-01-01'").select(F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("symbol"))))
query("x05_search", f"""{REFS}{HITS}, e AS (SELECT path, line, 0 AS source FROM refs WHERE symbol = 's3' UNION ALL SELECT path, line, 1 FROM hits WHERE regexp_matches(text, '(^|[^A-Za-z0-9_])s3($|[^A-Za-z0-9_])'))
SELECT path, line, min(source) AS source FROM e GROUP BY path, line ORDER BY source, path, line LIMIT 30""")(lambda s, d: g.search([_refs(s, d).where("symbol = 's3'").select("path", "line"), _hits(s, d).where(g.boundary(F.col("text"), "s3")).select("path", "line")], 30))
query("x23_modules", f"{REFS} SELECT string_split(path, '/')[1] AS name, count(DISTINCT path) AS file_count FROM refs GROUP BY 1")(lambda s, d: _refs(s, d).groupBy(F.split("path", "/")[0].alias("name")).agg(F.count_distinct("path").alias("file_count")))
query("x27_module_api", f"{REFS} SELECT symbol, path FROM refs WHERE section = 'definition' AND starts_with(path, 'src2/')")(lambda s, d: _refs(s, d).where((F.col("section") == "definition") & F.col("path").startswith("src2/")).select("symbol", "path"))
query("b17_area_imports", per_customer_sql("SELECT * FROM (VALUES ('./a§', 'internal', NULL), ('@x§/y/z', 'external', '@x§/y'), ('lodash§/get', 'external', 'lodash§'), ('../b§', 'internal', NULL)) t(source, kind, package)", "", "", "source, package"))(lambda s, d: per_customer(s, d, [("./a§",), ("@x§/y/z",), ("lodash§/get",), ("../b§",)], "source string").select("source", g.import_kind(F.col("source")).alias("kind"), F.when(g.import_kind(F.col("source")) == "external", g.package_name(F.col("source"))).alias("package")))
query("b20_stack", per_customer_sql("SELECT * FROM (VALUES ('a', 'Python', 2::BIGINT), ('b', 'Node', 1::BIGINT), ('c', 'PHP', 3::BIGINT)) t(project, language, n)", "project"))(lambda s, d: g.stack(per_customer(s, d, [("a", "Node"), ("a", "Python"), ("b", "Node"), ("c", "Rust"), ("c", "PHP"), ("c", "Go")], "project string, language string", ("project",))))
query("b18_explore")(lambda s, d: g.explore(_deps(s, d).select(F.col("module").alias("node")).distinct(), _deps(s, d).select(F.col("module").alias("a"), F.col("dep").alias("b")), s.createDataFrame([(0, 2.0), (5, 1.0)], "node int, weight double")))
query("b19_suffix_conventions", "SELECT regexp_extract(p_type, '([A-Z]+)$', 1) AS suffix, count(*) AS n FROM part GROUP BY 1")(lambda s, d: table(s, d, "part").groupBy(F.regexp_extract("p_type", "([A-Z]+)$", 1).alias("suffix")).agg(F.count("*").alias("n")))
query("p17_constructors", per_customer_sql("SELECT * FROM (VALUES ('run§'), ('new§'), ('init§')) t(name)", "", "", "name"))(lambda s, d: g.unused(per_customer(s, d, [("__init__",), ("__new__",), ("__del__",), ("constructor",), ("__str__",), ("run§",), ("new§",), ("init§",), ("used§",)], "name string"), per_customer(s, d, [("used§",)], "symbol string")))


def _fuzzy(spark, sf):
    """Names that all begin alike, so most trigrams are common; a third of the queries are misspelt."""
    index = saved(fz.name_index(table(spark, sf, "customer").select(F.col("c_name").alias("name"))), "names")
    k = F.col("s_suppkey")
    asked = table(spark, sf, "supplier").select(k.alias("id"), F.when(k % 3 == 0, F.replace("s_name", F.lit("Supplier"), F.lit("Custmer"))).when(k % 3 == 1, F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).otherwise(F.replace("s_name", F.lit("Supplier#"), F.lit("Customer"))).alias("query"))
    return fz.fuzzy_search(asked, index)


query("x05_fuzzy_search", """WITH q AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN replace(s_name, 'Supplier', 'Custmer') WHEN 1 THEN replace(s_name, 'Supplier', 'Customer') ELSE replace(s_name, 'Supplier#', 'Customer') END AS query FROM supplier)
SELECT id, query, c_name AS name, CAST(levenshtein(query, c_name) AS INTEGER) AS distance FROM q, (SELECT DISTINCT c_name FROM customer) WHERE levenshtein(query, c_name) <= 2""")(_fuzzy)


def _ways() -> str:
    out = [DEPS, "w1 AS (SELECT module AS node, CAST(1 AS DECIMAL(38,0)) AS n FROM module_deps WHERE dep = 14)"]
    out += [f"w{k} AS (SELECT module AS node, CAST(sum(w{k - 1}.n) AS DECIMAL(38,0)) AS n FROM w{k - 1} JOIN module_deps ON dep = node GROUP BY module)" for k in range(2, 21)]
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT CAST(node AS BIGINT) AS node, {k} AS depth, CAST(n AS VARCHAR) AS n FROM w{k}" for k in range(1, 21))


query("b11_walk_counts", _ways())(lambda s, d: g.walk_counts(_deps(s, d), 14, 20).withColumn("n", F.col("n").cast("string")))
RANK_ROUNDS = 40


def _ranks() -> str:
    out = [REFS, "e AS (SELECT DISTINCT symbol AS a, path AS b FROM refs UNION SELECT DISTINCT path, symbol FROM refs)", "p AS (SELECT a, b, 1.0::DOUBLE / count(*) OVER (PARTITION BY a) AS p FROM e)", "x0 AS (SELECT DISTINCT symbol AS query, symbol AS node, 1.0::DOUBLE AS score FROM refs WHERE CAST(symbol[2:] AS BIGINT) % 400 = 0)"]
    out += [f"x{k} AS (SELECT query, node, sum(score) AS score FROM (SELECT query, b AS node, score * p * 0.5 AS score FROM x{k - 1} JOIN p ON a = node UNION ALL SELECT query, node, 0.5 FROM x0) GROUP BY query, node)" for k in range(1, RANK_ROUNDS + 1)]
    return ", ".join(out) + f", r AS (SELECT query, node, round(score, 6) AS score FROM x{RANK_ROUNDS}), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, node) AS INTEGER) AS rank FROM r) SELECT query, node, score, rank FROM t WHERE rank <= 20"


def _explored(spark, sf):
    """Symbols and the files that hold them, as one graph, explored from several symbols at once."""
    r = _refs(spark, sf).select("symbol", "path").distinct()
    seeds = r.where(F.substring("symbol", 2, 20).cast("long") % 400 == 0).select(F.col("symbol").alias("query"), F.col("symbol").alias("node"), F.lit(1.0).alias("weight")).distinct()
    return g.ranked_near(r.select(F.col("symbol").alias("a"), F.col("path").alias("b")), seeds, 20, restart=0.5)


query("x07_ranked_exploration", _ranks())(_explored)
