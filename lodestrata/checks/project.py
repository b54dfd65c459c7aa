"""Queries over what a project is made of. Where the tables hold nothing of the kind, every customer has a project of a few rows of our own."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.checks.registry import query
from lodestrata.checks.structure import files as own_files
from lodestrata.operators import changes, project as p, structure as st
from lodestrata.operators.text import lines
from lodestrata.plans.spread import spread
from lodestrata.sources.adapters import duck, per_customer, per_customer_sql, table, view


def _values(rows, names, paths="", ids="", texts=""):
    """Rows of our own, for each customer."""

    def quoted(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"

    values = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) t({names})"
    return per_customer_sql(values, paths, ids, texts) if paths or ids or texts else values


ROOT = [
    ("phpstan.neon.dist", ""), ("phpstan.neon", ""), ("tsconfig.json", "{}"), ("web/jest.config.js", ""), ("pyproject.toml", "[tool.ruff]\nline-length = 100"), (".github/workflows/a.yml", ""),
    (".github/workflows/b.yaml", ""), (".github/workflows/c.txt", ""), (".circleci/config.yml", ""), ("compose.yaml", ""), ("README.md", "[tool.ruff]"),
]
TOOLS = [("quality", "PHPStan", 1), ("quality", "TypeScript", 1), ("quality", "Ruff", 1), ("ci", "GitHub Actions", 2), ("ci", "CircleCI", 1), ("docker", "Docker", 1)]
query("d24_tooling", "SELECT section, name, CASE WHEN n > 1 THEN n * (SELECT count(*) FROM customer) ELSE n END AS n FROM (" + _values(TOOLS, "section, name, n") + ")")(lambda s, d: p.tooling(per_customer(s, d, ROOT, "path string, content string")))

FOUND = [("a", "Python"), ("b", "Node.js/TypeScript"), ("b", "Go"), ("c", "Rust"), ("e", "Node.js/TypeScript"), ("f", "PHP"), ("f", "Go")]
SAYS = [("a", "python"), ("b", "TypeScript"), ("c", "Java"), ("d", "Go"), ("e", "javascript"), ("g", None)]
LEVELS = [("a", "high"), ("b", "medium"), ("c", "low"), ("d", "medium"), ("e", "high"), ("f", "medium"), ("g", "unknown")]
query("b20_stack_confidence", _values(LEVELS, "project, confidence", "project"))(lambda s, d: p.stack_confidence(per_customer(s, d, FOUND, "project string, type string", ("project",)), per_customer(s, d, SAYS, "project string, type string", ("project",))))

TREE = ["src/a.ts", "src/b.ts", "src/b.js", "src/lib/index.ts", "src/lib/deep/x.py", "src/store.ts", "src/store/index.ts", "src/kit.d.ts", "top.go", "src/no.css"]
IMPORTS = [
    ("src/a.ts", "./b", "src/b.ts"), ("src/a.ts", "./b.js", "src/b.js"), ("src/a.ts", "./lib", "src/lib"), ("src/a.ts", "./lib/../b", "src/b.ts"), ("src/a.ts", "/c§/src/lib/deep/x", "src/lib/deep/x.py"), ("src/a.ts", "../top", "top.go"),
    ("src/a.ts", "./no.css", "src/no.css"), ("src/lib/deep/x.py", "../../b", "src/b.ts"), ("src/a.ts", "./store", "src/store"), ("src/a.ts", "./kit", None), ("src/a.ts", "react", None), ("src/a.ts", "./none", None), ("top.go", "../top", None),
]


def _resolved(spark, sf, folders):
    tree = per_customer(spark, sf, [(x,) for x in TREE], "path string", ("path",))
    return p.resolved_imports(per_customer(spark, sf, [x[:2] for x in IMPORTS], "path string, source string", ("path",)), tree, folders)


INDEXED = {"./lib": "src/lib/index.ts", "./store": "src/store.ts"}
query("j06_resolved_imports", _values([x for x in IMPORTS if x[2]], "path, source, target", "path, target", "", "source"))(lambda s, d: _resolved(s, d, True))
query("j06_resolved_files", _values([(a, b, INDEXED.get(b, c)) for a, b, c in IMPORTS if c], "path, source, target", "path, target", "", "source"))(lambda s, d: _resolved(s, d, False))

query("j13_matching_paths", duck("refs") + """, a AS (SELECT DISTINCT path AS a FROM refs), b AS (SELECT DISTINCT concat('o', p_partkey, '.py') AS b FROM part UNION SELECT 'x/' || min(path) FROM refs)
SELECT a, b FROM a JOIN b ON ends_with(a, b) OR ends_with(b, a)""")(lambda s, d: _matching(s, d))


def _matching(spark, sf):
    refs = view(spark, sf, "refs")
    short = table(spark, sf, "part").select(F.concat(F.lit("o"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    return p.matching_paths(refs.select("path"), short.unionByName(refs.agg(F.concat(F.lit("x/"), F.min("path")).alias("path"))))


UNUSED = [("src/engine.py", "load", 11), ("src/engine.py", "ready", 23), ("src/engine.py", "Engine§", 15), ("src/engine.py", "load", 400)]
DECORATED = [("src/engine.py", "load", 11, "@cache,@app.route"), ("src/engine.py", "ready", 23, "@property"), ("src/engine.py", "Engine§", 15, ""), ("src/engine.py", "load", 400, "")]
query("j05_decorators", _values(DECORATED, "path, name, line, decorators", "path", "", "name"))(lambda s, d: p.with_decorators(per_customer(s, d, UNUSED, "path string, name string, line long", ("path",)), st.symbols(own_files(s, d))))
query("x22_annotated", _values([("src/engine.py", "ready")], "path, name", "path"))(lambda s, d: st.annotated(st.symbols(own_files(s, d)), "Property").select("path", "name"))

KIN = [
    ("a.ts", "export abstract class Dog§<T> extends Animal<T, Map<K, V>> implements Pet, Noisy {\n}\ninterface Pet extends Named, Aged {\nclass Plain {\nexport default class Cat implements Pet {"),
    ("b.py", "class Base:\n    pass\nclass Child(Base, mixins.Loud, metaclass=Meta):\n    class Inner(Base): pass"),
]
EDGES = [
    ("a.ts", 1, "Dog§", "Animal", "extends"), ("a.ts", 1, "Dog§", "Pet", "implements"), ("a.ts", 1, "Dog§", "Noisy", "implements"), ("a.ts", 3, "Pet", "Named", "extends"), ("a.ts", 3, "Pet", "Aged", "extends"), ("a.ts", 5, "Cat", "Pet", "implements"),
    ("b.py", 3, "Child", "Base", "extends"), ("b.py", 3, "Child", "mixins.Loud", "extends"), ("b.py", 4, "Inner", "Base", "extends"),
]


def _edges(spark, sf):
    return p.heritage(lines(per_customer(spark, sf, KIN, "path string, content string", ("path",))))


query("b13_heritage", _values(EDGES, "path, line, name, parent, kind", "path", "", "name, parent"))(lambda s, d: _edges(s, d))
query("x08_implementations", _values([("Dog§", "a.ts", 1), ("Cat", "a.ts", 5)], "name, path, line", "path", "", "name"))(lambda s, d: p.implementations(_edges(s, d), "Pet"))
PET = [("parent", "Named", "extends", None, None), ("parent", "Aged", "extends", None, None), ("child", "Dog§", "implements", "a.ts", 1), ("child", "Cat", "implements", "a.ts", 5)]
query("x09_hierarchy", "SELECT DISTINCT * FROM (" + _values(PET, "section, name, kind, path, line", "path", "", "name") + ")")(lambda s, d: p.hierarchy(_edges(s, d), "Pet"))

CAPPED = [(1, 1, "small", 2, True, True), (1, 2, "large", 5, False, True), (1, 3, "bin", 0, False, True), (1, 4, "late", 1, True, False)]


def _capped(spark, sf):
    head = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1 +1 @@\n"
    raw = head.format("small") + "-a\n+b\n" + head.format("large") + "+1\n+2\n+3\n+4\n 5\n" + "diff --git a/bin b/bin\nBinary files a/bin and b/bin differ\n" + head.format("late") + "+x\n" + head.format("last") + "+x"
    ls = spread(per_customer(spark, sf, [(1, raw)], "diff_id long, raw string", (), ("diff_id",)), "diff_id").select("diff_id", F.posexplode(F.split("raw", "\n", -1)).alias("line_no", "text"))
    parsed = changes.parse_diff(ls)
    return p.capped_diff(parsed, changes.file_diffs(parsed), None, 4, 4, 12)


query("c09_capped_diff", _values(CAPPED, "diff_id, file_no, path, hunk_lines, inlined, shown", "", "diff_id", "path"))(lambda s, d: _capped(s, d))

OVERVIEW = "PROJECT: x\nTYPE (high): Node.js/TypeScript\nFRAMEWORKS: express§, zod,\nARCHITECTURE: layered\nPATTERNS: *Service.ts, *.test.ts\nMAP:\n  src/ (12 files, 40 symbols)\n  docs/ (3 files)\n  library/ (1 files)"
PRINTS = [(1, "Node.js/TypeScript", "express§,zod", 12, "*Service.ts,*.test.ts", "layered", 3, "src/,library/"), (2, None, "", 0, "", None, 0, "")]
query("f20_fingerprint", _values(PRINTS, "id, project_type, frameworks, files, patterns, architecture, modules, entrypoints", "", "id", "frameworks"))(lambda s, d: _prints(s, d))


def _prints(spark, sf):
    f = p.fingerprint(F.col("t"))
    joined = lambda c: F.array_join(f"f.{c}", ",").alias(c)
    d = per_customer(spark, sf, [(1, OVERVIEW), (2, "nothing")], "id long, t string", (), ("id",)).select("id", f.alias("f"))
    return d.select("id", "f.project_type", joined("frameworks"), "f.files", joined("patterns"), "f.architecture", "f.modules", joined("entrypoints"))


SIGNALS = [("raw", 9, "tail"), ("import", 1, "import os"), ("class", 5, "class A"), ("export", 7, "export x"), ("function", 6, "def f")]
WHOLE = "H\n\nNote: n\n\n=== Imports ===\nL1: import os\n\n=== Exports / Public symbols ===\nL7: export x\n\n=== Declarations ===\nL5: class A\nL6: def f\n\n=== Content preview (head + tail) ===\nL9: tail\n\nF"
SHORT = "H\n\nNote: n\n\n=== Imports ===\nL1: import os\n\n=== Exports / Public symbols ===\nL7: export x\n\n=== Declarations ===\nL5: class A\nL6: def f\n\n(trimmed to fit budget)\n\nF"
BARE = "H\n\nNote: n\n\n(trimmed to fit budget)\n\nF"


def _escaped(s):
    return "'" + s.replace("\n", "|") + "'"


query("p10_denial", per_customer_sql(f"SELECT * FROM (VALUES (1::BIGINT, {_escaped(WHOLE)}), (2, {_escaped(SHORT)}), (3, {_escaped(BARE)})) t(id, text)", "", "id", "text"))(lambda s, d: _denials(s, d))


def _denials(spark, sf):
    signals = [dict(zip(("kind", "line", "text"), x, strict=True)) for x in SIGNALS]
    d = per_customer(spark, sf, [(0, signals)], "id long, signals array<struct<kind:string,line:int,text:string>>", (), ("id",))
    say = lambda k, most: d.select((F.col("id") + k).alias("id"), F.translate(p.denial(F.lit("H"), F.col("signals"), F.lit("n"), F.lit("F"), most), "\n", "|").alias("text"))
    return say(1, 1200).unionByName(say(2, 35)).unionByName(say(3, 1))
