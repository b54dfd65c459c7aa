"""Queries over files, lines and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.functions import exprs as e
from lodestrata.operators import notations as nt
from lodestrata.operators import text as x
from lodestrata.plans.spread import spread, unbroadcast
from lodestrata.sources.adapters import duck, per_customer, per_customer_sql, table, view

FILES = duck("files")
LINES = FILES + """, lines AS (SELECT path, i AS line_no, l[i] AS text FROM (SELECT path, string_split(content, chr(10)) AS l FROM files) f, unnest(range(1, len(l) + 1)) r(i))"""
WS = "regexp_replace({c}, '[\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]', '', 'g')"
TOKENS = lambda c: f"CAST(CASE WHEN length({c}) = 0 THEN 0 ELSE ceil(ceil(length({c}) / 4) * (1 - 0.3::DOUBLE * (length({c}) - length({WS.replace('{c}', c)})) / length({c}))) END AS BIGINT)"


def _files(spark, sf):
    return view(spark, sf, "files")


def _lines(spark, sf):
    return x.lines(_files(spark, sf))


#: Small documents in the notations that the tables do not hold.
NOTES = [
    ("a.md", "# Top\nintro\n## One §\ntext\n### Deep\nmore\n## Two\n```\n# fenced\n```\nlast"),
    ("b.md", "no heading\n\n###### six\n# one"),
    ("c.md", ""),
    ("d.yaml", "name: x\nlist:\n  - a\n  - b\n\nother-key : 1\n# c\nlast: 2\n"),
    ("e.csv", "id,name\n1,a\n\n2,b\n3,c\n"),
    ("f.toml", "[package]\nname = 1\n[[bin]]\n[a.b]\nx = [1]\n"),
    ("g.py", "import os\nclass A:\n    def f(self): pass\n# TODO later\nx = 1  # FIXME now\nNOTEPAD = 1"),
]
NOTES_SQL = "WITH files AS (" + per_customer_sql("SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(p, c.replace("\n", "'||chr(10)||'")) for p, c in NOTES) + ") t(path, content)", "path", "", "content") + ")" + LINES[len(FILES):]


def _notes(spark, sf):
    return x.lines(per_customer(spark, sf, NOTES, "path string, content string", ("path",)))


query("s01_scan", f"{FILES} SELECT path, sha256(content) AS content_hash, strlen(content)::BIGINT AS bytes, len(string_split(content, chr(10)))::BIGINT AS n_lines, {TOKENS('content')} AS tokens FROM files")(lambda s, d: x.scan(_files(s, d)))
query("s02_lines", f"{LINES} SELECT path, line_no, text FROM lines")(_lines)
query("t04_read_range", f"{LINES} SELECT path, line_no, text FROM lines WHERE line_no BETWEEN 2 AND 3")(lambda s, d: x.read_range(_lines(s, d), 2, 3))
query("n08_numbered", f"{LINES} SELECT path, line_no, text, repeat(' ', greatest(0, 4 - length(line_no::VARCHAR))) || line_no || ' | ' || text AS shown FROM lines")(lambda s, d: x.numbered(_lines(s, d)))
query("p08_head_tail", f"{LINES} SELECT path, line_no, text FROM (SELECT *, max(line_no) OVER (PARTITION BY path) AS n FROM lines) l WHERE line_no <= 5 OR line_no > n - 3")(lambda s, d: x.head_tail(_lines(s, d), 5, 3))
ENDINGS = "ends_with(path, '.py') OR ends_with(path, '.ts')"
query("s04_directory_counts", duck("refs") + f" SELECT string_split(path, '/')[1] AS dir, count(*) AS n_files FROM (SELECT DISTINCT CASE WHEN ends_with(path, '.go') THEN path || 'x' ELSE path END AS path FROM refs) q WHERE {ENDINGS} GROUP BY 1")(lambda s, d: x.directory_counts(_paths(s, d)))
query("s03_by_extension", duck("refs") + f" SELECT path FROM (SELECT DISTINCT CASE WHEN ends_with(path, '.go') THEN path || 'x' ELSE path END AS path FROM refs) q WHERE {ENDINGS}")(lambda s, d: x.by_extension(_paths(s, d)))
query("s03_code_extensions", per_customer_sql("SELECT * FROM (VALUES ('a.mjs'), ('b.KTS'), ('c.lisp'), ('d/e.proto'), ('f.m')) t(path)", "path"))(lambda s, d: x.by_extension(per_customer(s, d, [("a.mjs",), ("b.KTS",), ("c.lisp",), ("d/e.proto",), ("f.m",), ("g.md",), ("h",), ("i.json",), (".ts.x",)], "path string", ("path",))))


def _paths(spark, sf):
    """Paths of the references, of which those in .go stand for files of an ending that is no code."""
    path = F.when(F.col("path").endswith(".go"), F.concat("path", F.lit("x"))).otherwise(F.col("path"))
    return view(spark, sf, "refs").select(path.alias("path")).distinct()


query("f01_token_estimate", f"{FILES} SELECT doc_id, {TOKENS('content')} AS tokens FROM files")(lambda s, d: _files(s, d).select("doc_id", e.token_estimate(F.col("content")).alias("tokens")))
query("t01_small_large", f"""{FILES}, o AS (SELECT path, content, len(string_split(content, chr(10)))::BIGINT AS n_lines, {TOKENS('content')} AS tokens,
 array_to_string(list_transform(string_split(content, chr(10)), lambda v: v[1:40]), chr(10)) AS o FROM files), q AS (SELECT path, n_lines, tokens, {TOKENS('o')} AS outline_tokens FROM o)
SELECT path, n_lines, tokens, outline_tokens, CASE WHEN n_lines <= 2 THEN 'whole' WHEN outline_tokens >= 0.7::DOUBLE * tokens THEN 'whole_by_ratio' ELSE 'outline' END AS how FROM q""")(lambda s, d: x.small_large(_files(s, d), 2))
query("n01_markdown_sections", f"""{NOTES_SQL}, h AS (SELECT path, line_no, length(regexp_extract(text, '^(#+)', 1)) AS level, trim(regexp_extract(text, '^#+ (.*)$', 1)) AS title FROM lines WHERE regexp_matches(text, '^#{{1,6}} '))
SELECT path, level, title, line_no AS start_line, coalesce((SELECT min(n.line_no) - 1 FROM h n WHERE n.path = h.path AND n.line_no > h.line_no AND n.level <= h.level), (SELECT max(line_no) FROM lines l WHERE l.path = h.path)) AS end_line FROM h""")(lambda s, d: x.markdown_sections(_notes(s, d)))
query("n02_yaml_sections", f"""{NOTES_SQL}, k AS (SELECT path, line_no, regexp_extract(text, '^([A-Za-z0-9_.-]+)', 1) AS key FROM lines WHERE regexp_matches(text, '^[A-Za-z_][A-Za-z0-9_.-]*:'))
SELECT path, key, line_no AS start_line, coalesce(lead(line_no) OVER (PARTITION BY path ORDER BY line_no) - 1, (SELECT max(line_no) FROM lines l WHERE l.path = k.path)) AS end_line FROM k""")(lambda s, d: x.yaml_sections(_notes(s, d)))
query("n05_find_section", per_customer_sql("SELECT 'a.md' AS path, 7::BIGINT AS start_line, 8::BIGINT AS end_line", "path"))(lambda s, d: x.find_section(x.markdown_sections(_notes(s, d)), "## TWO "))
query("n04_csv_rows", f"{NOTES_SQL} SELECT path, line_no, text, (SELECT count(*) FILTER (trim(text) <> '') - 1 FROM lines k WHERE k.path = lines.path) AS n_rows FROM lines WHERE ends_with(path, '/e.csv') AND (line_no = 1 OR line_no BETWEEN 3 AND 4)")(lambda s, d: x.csv_rows(_notes(s, d).where("path like '%/e.csv'"), 2, 3))
query("s08_toml_tables", f"{NOTES_SQL} SELECT path, line_no, regexp_extract(text, '\\[\\[?([^\\[\\]]+)\\]', 1) AS name FROM lines WHERE regexp_matches(text, '^\\s*\\[\\[?[^\\[\\]]+\\]\\]?\\s*$')")(lambda s, d: x.toml_tables(_notes(s, d)))
query("n09_code_blocks", f"{NOTES_SQL} SELECT path, CAST(floor(count(*) / 2) AS BIGINT) AS blocks FROM lines WHERE starts_with(text, '```') GROUP BY path")(lambda s, d: x.code_blocks(_notes(s, d)))
LONG = "export const a = " + "x" * 200
CODE = [
    ("a.ts", f"import b from 'b'\nconst c = require('c')\n{LONG}\nclass D {{\n  async function e()\nfoo()"), ("b.py", "from os import path\n  import re\nexport = 1\nasync def f():\nclass G§: pass\ndefault = 1"),
    ("c.go", "import \"fmt\"\nfunc main() {\ntype T struct {\ntype U int"), ("d.rs", "use std::io;\npub fn f() {\nfn g() {\nmod h;\nlet x = 1;"), ("e.txt", "import a\nclass B"),
]
SIGNALS = [
    ("a.ts", 1, "import", "import b from ''b''"), ("a.ts", 2, "import", "const c = require(''c'')"), ("a.ts", 3, "export", LONG[:139] + "…"), ("a.ts", 4, "declaration", "class D {"), ("a.ts", 5, "declaration", "async function e()"),
    ("b.py", 1, "import", "from os import path"), ("b.py", 2, "import", "import re"), ("b.py", 4, "declaration", "async def f():"), ("b.py", 5, "declaration", "class G§: pass"),
    ("c.go", 1, "import", "import \"fmt\""), ("c.go", 2, "declaration", "func main() {"), ("c.go", 3, "declaration", "type T struct {"), ("d.rs", 1, "import", "use std::io;"), ("d.rs", 2, "export", "pub fn f() {"), ("d.rs", 3, "declaration", "fn g() {"), ("d.rs", 4, "declaration", "mod h;"),
]
query("p07_regex_summary", per_customer_sql("SELECT * FROM (VALUES " + ", ".join(f"('{p}', {n}::BIGINT, '{k}', '{t}')" for p, n, k, t in SIGNALS) + ") t(path, line_no, kind, text)", "path", "", "text"))(lambda s, d: x.regex_summary(x.lines(per_customer(s, d, CODE, "path string, content string", ("path",)))))
SUMMARY_SQL = "CASE WHEN ends_with(path, '/g.py') AND (starts_with(text, 'import ') OR starts_with(text, 'class ') OR starts_with(text, '    def ')) THEN 'x' END"
query("p09_tiered", f"""{NOTES_SQL}, a AS (SELECT path, line_no, {SUMMARY_SQL} AS k FROM lines), t AS (SELECT path, line_no, 0 AS tier FROM a WHERE k IS NOT NULL UNION ALL SELECT path, line_no, 1 FROM lines WHERE line_no <= 2)
SELECT path, line_no, tier FROM t WHERE tier = (SELECT min(tier) FROM t u WHERE u.path = t.path)""")(lambda s, d: x.tiered([x.regex_summary(_notes(s, d)).select("path", "line_no"), x.head_tail(_notes(s, d), 2, 0).select("path", "line_no")]))
query("x20_marked_lines", f"{NOTES_SQL} SELECT path, line_no, regexp_extract(text, '\\b(TODO|FIXME|HACK|XXX|NOTE|WARNING|WARN)\\b', 1) AS kind, trim(text) AS text FROM lines WHERE regexp_matches(text, '\\b(TODO|FIXME|HACK|XXX|NOTE|WARNING|WARN)\\b')")(lambda s, d: x.marked_lines(_notes(s, d)))
query("s05_json_outline", "SELECT event_id, k AS key, 'number' AS kind FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)")(lambda s, d: nt.json_outline(table(s, d, "events"), "props", "event_id"))
query("x01_stats", f"{FILES} SELECT count(*) AS n_files FROM files")(lambda s, d: _files(s, d).agg(F.count("*").alias("n_files")))
query("x10_files", f"{FILES} SELECT path FROM files")(lambda s, d: _files(s, d).select("path"))
query("x12_map", f"{FILES} SELECT string_split(path, '/')[1] AS dir, language, count(*) AS n FROM files GROUP BY ALL")(lambda s, d: _files(s, d).groupBy(F.split("path", "/")[0].alias("dir"), "language").agg(F.count("*").alias("n")))
query("s15_transcript_tokens", f"""SELECT conv_id, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), arg_max(turn * 10, turn)) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")(lambda s, d: x.transcript_tokens(table(s, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", F.length("text")).alias("output_tokens"), (F.col("turn") * 10).alias("total_tokens"))))


@query("x02_incremental_index", f"{FILES} SELECT path, sha256(content) AS content_hash, doc_id % 3 = 0 AS changed FROM files WHERE doc_id % 7 <> 0")
def x02(spark, sf):
    """Rows of the old index stay where the hash is the same; the others are taken from the new scan."""
    f = _files(spark, sf)
    old = x.scan(f.withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))).select("path", F.col("content_hash").alias("was"))
    new = x.scan(f.where("doc_id % 7 <> 0")).select("path", "content_hash")
    return new.join(old, "path", "left").select("path", "content_hash", (~F.col("was").eqNullSafe(F.col("content_hash"))).alias("changed"))


SHOW = lambda c: "CAST(CASE WHEN length({c}) = 0 THEN 0 ELSE ceil(ceil(length({c}) / 4) * (1 - 0.3::DOUBLE * (length({c}) - length({w})) / length({c}))) END AS BIGINT)".replace("{w}", WS).replace("{c}", c)


@query("d17_token_budget", f"""WITH RECURSIVE f AS (SELECT doc_id // 20 AS batch, concat(source, '/', lang, '/doc_', doc_id, '.txt') AS path, coalesce(text, '') AS c FROM documents),
t AS (SELECT *, array_to_string(string_split(c, chr(10))[1:24], chr(10)) || chr(10) || chr(10) || '... compacted for batch mode. Use smart_read("' || path || '") for full detail.' AS k, 'FILE: ' || path || chr(10) || '(compacted in batch mode — use smart_read("' || path || '") for full detail)' AS u FROM f),
n AS (SELECT batch, path, row_number() OVER (PARTITION BY batch ORDER BY path) AS i, {SHOW('c')} AS whole, {SHOW('k')} AS cut, {SHOW('u')} AS stub FROM t),
r(batch, i, path, shown, given, rest) AS (SELECT batch, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, 1400::BIGINT FROM (SELECT DISTINCT batch FROM n) UNION ALL
  SELECT batch, i, path, shown, given, greatest(0, rest - given) FROM (SELECT n.batch, n.i, n.path, r.rest, CASE WHEN rest <= 60 THEN 'stub' WHEN whole <= least(220, rest) THEN 'whole' ELSE 'cut' END AS shown, CASE WHEN rest <= 60 THEN stub WHEN whole <= least(220, rest) THEN whole ELSE cut END AS given FROM r JOIN n ON n.batch = r.batch AND n.i = r.i + 1))
SELECT batch, path, shown, given FROM r WHERE i > 0""")
def d17(spark, sf):
    """Batches of twenty documents each."""
    return x.token_budget(_files(spark, sf).select(F.floor(F.col("doc_id") / 20).cast("long").alias("batch"), "path", "content"))


#: A YAML text for each order: its lines are list items with a key below each.
YAML_HEAD = "# order\n\nid: {id}  # its key\nstate: {state}\ncustomer:\n  id: {cust}\n  place:\n    nation:\n      name: x\n    tags: [a]\n  - loose\nlines:"
YAML_TAIL = "\nlast: |\n  text: inside\n  - item\nend: '#{id}'"


def _yaml_files(spark, sf):
    line = F.format_string("\n  - n: %d\n    q%d: %d", F.col("l_linenumber").cast("int"), F.col("l_linenumber").cast("int"), F.col("l_quantity").cast("int"))
    orders = table(spark, sf, "orders")
    n = orders.count()
    per = spread(table(spark, sf, "lineitem"), "l_orderkey", rows=n).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", line.alias("t")))), lambda y: y["t"]), "").alias("t"))
    o = spread(orders, "o_orderkey", rows=n).join(unbroadcast(per), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = F.concat(F.lit(YAML_HEAD), F.coalesce("t", F.lit("")), F.lit(YAML_TAIL))
    for k, v in (("{id}", "o_orderkey"), ("{state}", "o_orderstatus"), ("{cust}", "o_custkey")):
        text = F.replace(text, F.lit(k), F.col(v).cast("string"))
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".yaml")).alias("path"), text.alias("content"))


query("s06_yaml_outline", """WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS n, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS of FROM lineitem), o AS (SELECT *, (SELECT count(*) FROM l WHERE l_orderkey = o_orderkey) AS m FROM orders),
f AS (SELECT o_orderkey, m, unnest([
 {'ord': 0, 'depth': 1, 'kp': 'id', 'v': CAST(o_orderkey AS VARCHAR), 'nk': 0, 'ni': 0, 's': 3, 'e': 3}, {'ord': 1, 'depth': 1, 'kp': 'state', 'v': o_orderstatus, 'nk': 0, 'ni': 0, 's': 4, 'e': 4}, {'ord': 2, 'depth': 1, 'kp': 'customer', 'v': NULL, 'nk': 2, 'ni': 1, 's': 5, 'e': 11},
 {'ord': 3, 'depth': 2, 'kp': 'customer.id', 'v': CAST(o_custkey AS VARCHAR), 'nk': 0, 'ni': 0, 's': 6, 'e': 6}, {'ord': 4, 'depth': 2, 'kp': 'customer.place', 'v': NULL, 'nk': 2, 'ni': 0, 's': 7, 'e': 11}, {'ord': 5, 'depth': 3, 'kp': 'customer.place.nation', 'v': NULL, 'nk': 1, 'ni': 0, 's': 8, 'e': 9},
 {'ord': 6, 'depth': 3, 'kp': 'customer.place.tags', 'v': NULL, 'nk': 0, 'ni': 0, 's': 10, 'e': 11}, {'ord': 7, 'depth': 1, 'kp': 'lines', 'v': NULL, 'nk': m, 'ni': m, 's': 12, 'e': 12 + 2 * m}, {'ord': 8 + m, 'depth': 1, 'kp': 'last', 'v': NULL, 'nk': 1, 'ni': 1, 's': 13 + 2 * m, 'e': 15 + 2 * m},
 {'ord': 9 + m, 'depth': 2, 'kp': 'last.text', 'v': 'inside', 'nk': 0, 'ni': 0, 's': 14 + 2 * m, 'e': 15 + 2 * m}, {'ord': 10 + m, 'depth': 1, 'kp': 'end', 'v': chr(39), 'nk': 0, 'ni': 0, 's': 16 + 2 * m, 'e': 16 + 2 * m}]) AS r FROM o),
a AS (SELECT o_orderkey, r.ord AS ord, r.depth AS depth, r.kp AS key_path, r.v AS value, r.nk AS n_keys, r.ni AS n_items, r.s AS start_line, r.e AS end_line FROM f UNION ALL SELECT l_orderkey, 7 + i, 2, 'lines.q' || n, q, 0, 0, 12 + 2 * i, least(13 + 2 * i, 12 + 2 * of) FROM l)
SELECT 'o' || o_orderkey || '.yaml' AS path, CAST(ord AS INTEGER) AS ord, CAST(depth AS INTEGER) AS depth, string_split(key_path, '.')[-1] AS key, key_path, value, CAST(n_keys AS INTEGER) AS n_keys, CAST(n_items AS INTEGER) AS n_items, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM a""")(lambda s, d: nt.yaml_outline(_yaml_files(s, d)))


def _csv_files(spark, sf):
    """Every document as CSV: a row for each of its lines, which stands in quotes."""
    row = lambda t, i: F.concat(i.cast("string"), F.lit(' ,"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('", '), F.length(t).cast("string"))
    return _files(spark, sf).select("path", F.concat(F.lit('n,"the ""text"", whole",size\n\n'), F.array_join(F.transform(F.split(F.coalesce("content", F.lit("")), "\n", -1), row), "\n")).alias("content"))


TRIMMED = "regexp_replace({c}, '^" + e.SPACE_CLASS.replace("\\t", "\t").replace("\\r", "\r") + "+|" + e.SPACE_CLASS + "+$', '', 'g')"
query("s09_csv_outline", f"""{FILES}, c AS (SELECT path, string_split(coalesce(content, ''), chr(10)) AS l FROM files)
SELECT path, ['n', 'the "text", whole', 'size'] AS columns, CAST(len(l) AS BIGINT) AS row_count, list_transform(range(1, least(len(l), 5) + 1), lambda i: [CAST(i - 1 AS VARCHAR), {TRIMMED.replace('{c}', 'l[i]')}, CAST(length(l[i]) AS VARCHAR)]) AS sample FROM c""")(lambda s, d: nt.csv_outline(_csv_files(s, d)))


def _json_orders(spark, sf):
    """An object for each order, of values that look like others and keys that hold a dot."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    some = lambda f: F.array_join(F.transform(F.filter(F.sequence(F.lit(0), k % 4), lambda i: i > 0), f), ",")
    text = F.concat(
        F.lit('{"id":'), k.cast("string"), F.lit(',"id.text":"'), k.cast("string"), F.lit('","open":"[x","yes":"true","flag":'), F.when(k % 2 == 0, "true").otherwise("false"),
        F.lit(',"no":null,"list":['), some(lambda i: i.cast("string")), F.lit('],"map":{'), some(lambda i: F.concat(F.lit('"k'), i.cast("string"), F.lit('":[{}]'))), F.lit('},"e":-1.5e3}'),
    )
    return o.select("o_orderkey", F.when(k % 10 == 9, F.concat(text, F.lit("}"))).otherwise(text).alias("doc"))


query("n09_json_kinds", """SELECT o_orderkey, unnest(['id', 'id.text', 'open', 'yes', 'flag', 'no', 'list', 'map', 'e']) AS key, unnest(['number', 'string', 'string', 'string', 'boolean', 'object', 'array[' || (o_orderkey % 4) || ']', 'object{' || (o_orderkey % 4) || ' keys}', 'number']) AS kind
FROM orders WHERE o_orderkey % 10 <> 9""")(lambda s, d: nt.json_outline(_json_orders(s, d), "doc", "o_orderkey"))
