"""Methods by indent against a version that goes line by line."""

import random
import re

from lodestrata.operators import classes as c

PY = """class Service(Base):
    x = 1

    @cached
    @app.route("/x")
    def get(self):
        def inner(): pass
        return 1

    # note

    @staticmethod
    def make(a):
        pass
    @classmethod

    def late(cls): return 2
    async def load(self):
        pass
    def __init__(self):
        pass

    def __hidden(self): pass
    def _own(self): pass  # async def
    def  wide (self): pass
class Empty:
    pass
class Deep:
  if x:
        def far(self): pass
  def near(self): pass"""

PHP = """<?php
class User extends Model {
    private $x;
    public function name() { return $this->x; }
    private static function make($a) {
        $f = function ($q) { return 1; };
    }
    static public function odd() {}
    abstract protected function soon();
    function plain() {}
}
class Other {
	public function tabbed() {}
}"""


def _python(lines, start, end):
    first = next((m for x in lines[start:end] if (m := re.match(r"(\s+)def\s", x))), None)
    out = []
    if first:
        w = len(first[1])
        at = [i for i in range(start, min(end, len(lines))) if re.match(rf"\s{{{w}}}def\s+(\w+)\s*\(", lines[i])]
        for k, i in enumerate(at):
            name = re.match(r"\s*def\s+(\w+)", lines[i])[1]
            decorators = []
            for x in reversed(lines[start:i]):
                m = re.match(rf"\s{{{w}}}@(\w+)", x)
                if not m:
                    break
                decorators.insert(0, "@" + m[1])
            stop = end
            if k + 1 < len(at):
                stop = at[k + 1]
                while stop - 1 > i and (not lines[stop - 1].strip() or re.match(rf"\s{{{w}}}@", lines[stop - 1])):
                    stop -= 1
            static, cls = (bool(re.match(rf"\s*@{d}", lines[i - 1])) for d in ("staticmethod", "classmethod"))
            seen = "private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") else "public"
            out.append((name, "function" if static or cls else "method", i + 1, stop, lines[i].strip(), seen, "async def" in lines[i], static, decorators))
    return out


def _rows(df):
    return sorted(tuple(r[2:]) for r in df.collect())


def test_python_methods(spark):
    files = spark.createDataFrame([("a.py", PY), ("b.py", None)], "path string, content string")
    ranges = [("a.py", "Service", 1, 25), ("a.py", "Empty", 26, 27), ("a.py", "Deep", 28, 31), ("b.py", "None", 1, 9), ("gone.py", "X", 1, 2)]
    got = c.python_methods(files, spark.createDataFrame(ranges, "path string, name string, start_line long, end_line long")).collect()
    lines = PY.split("\n")
    for name, start, end in (r[1:] for r in ranges[:3]):
        assert sorted(tuple(r[2:]) for r in got if r.parent == name) == sorted(_python(lines, start, end)), name
    assert {r.name for r in got} == {"get", "make", "late", "__init__", "__hidden", "_own", "wide", "far"}
    one = {r.name: r for r in got}
    assert (one["get"].decorators, one["get"].end_line, one["make"].is_static, one["late"].decorators, one["far"].start_line) == (["@cached", "@app"], 10, True, [], 30)


def test_python_methods_of_random_files(spark):
    rng = random.Random(6)
    kinds = ["class A:", "    def f(self):", "    def _g(self): pass", "        def h(): pass", "    @staticmethod", "    @x.y", "", "        pass", "  def k(a):", "    async def m(self):", "\tdef t(self):"]
    files, ranges, want = [], [], []
    for i in range(60):
        lines = ["class C:"] + [rng.choice(kinds) for _ in range(rng.randint(0, 20))]
        cut = rng.randint(1, len(lines))
        for name, lo, hi in (("C", 1, cut), ("D", cut, len(lines) + rng.randint(0, 1))):
            ranges.append((f"f{i}", name, lo, hi))
            want += [(f"f{i}", name, *m) for m in _python(lines, lo, hi)]
        files.append((f"f{i}", "\n".join(lines)))
    got = c.python_methods(spark.createDataFrame(files, "path string, content string"), spark.createDataFrame(ranges, "path string, name string, start_line int, end_line int"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_php_methods(spark):
    files = spark.createDataFrame([("u.php", PHP)], "path string, content string")
    ranges = spark.createDataFrame([("u.php", "User", 2, 11), ("u.php", "Other", 12, 14)], "path string, name string, start_line long, end_line long")
    got = c.php_methods(files, ranges)
    assert _rows(got) == [
        ("make", "function", 5, 9, "private static function make($a) {", "private", True), ("name", "method", 4, 4, "public function name() { return $this->x; }", "public", False),
        ("plain", "method", 10, 11, "function plain() {}", "public", False), ("tabbed", "method", 13, 14, "public function tabbed() {}", "public", False),
    ]
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "Python" not in plan
    assert c.php_methods(files.limit(0), ranges).count() == 0
