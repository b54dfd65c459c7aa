"""YAML, CSV and JSON by kind against plain versions; paths and cache keys."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import gates, notations


def _csv_row(line):
    """Character by character."""
    out, now, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"' and quoted and line[i + 1 : i + 2] == '"':
            now += c
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out.append(now.strip())
            now = ""
        else:
            now += c
        i += 1
    return [*out, now.strip()]


def test_csv_fields(spark):
    rng = random.Random(1)
    lines = ['a,b', '"a,b",c', '"say ""hi""", x ', '"open, to the end', '""', '""""', ',,', '', 'a"b,c"d,e', '\x01b,\x01a', '"",""', ' "x" , y', '"a"b"c,d']
    lines += ["".join(rng.choice('ab," \x01') for _ in range(rng.randint(0, 14))) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    for r in d.select("i", notations.csv_fields(F.col("line")).alias("f")).collect():
        assert r.f == _csv_row(lines[r.i]), lines[r.i]


def test_csv_outline(spark):
    rows = [("a", 'id,"full name"\n1,"Doe, J"\n\n2,x\n3,y\n4,z\n5,\n6,\n'), ("b", ""), ("c", None), ("d", "\n \nonly\n")]
    got = {r.path: r for r in notations.csv_outline(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert (got["a"].columns, got["a"].row_count, len(got["a"].sample), got["a"].sample[0]) == (["id", "full name"], 6, 5, ["1", "Doe, J"])
    assert [(got[k].columns, got[k].row_count, got[k].sample) for k in "bcd"] == [([], 0, []), ([], 0, []), (["only"], 0, [])]


def _tree(content):
    """Shown keys by looking back for each line: (key_path, depth, n_items)."""
    lines = content.split("\n")
    indent = lambda x: len(x) - len(x.lstrip())
    events = [(i, indent(x), x.lstrip().startswith("- "), x.strip().split(":")[0]) for i, x in enumerate(lines) if x.strip() and (x.lstrip().startswith("- ") or ":" in x)]

    def above(k):
        least = events[k][1]
        for e in reversed(range(k)):
            if events[e][1] < least:
                if not events[e][2]:
                    return e
                least = events[e][1]
        return None

    def chain(k):
        out = [k]
        while (k := above(k)) is not None:
            out.insert(0, k)
        return out

    rows = []
    for k, (_, _, item, _) in enumerate(events):
        if not item and len(chain(k)) <= 3:
            rows.append((".".join(events[e][3] for e in chain(k)), len(chain(k)), sum(events[x][2] and above(x) == k for x in range(len(events)))))
    return rows


def test_yaml_against_looking_back():
    rng = random.Random(2)
    for _ in range(400):
        text = "\n".join(" " * rng.choice([0, 0, 1, 2, 4, 6]) + rng.choice(["- x", "- y: 1"] + [f"{k}:" for k in "abcdef"]) for _ in range(rng.randint(0, 14)))
        assert [(n[3], n[1], n[6]) for n in notations.yaml_nodes(text)] == _tree(text)


def test_yaml_lines_values_and_limits(spark):
    many = "root:\n" + "".join(f"  k{i}: {i}\n    x: 1\n" for i in range(25)) + "end: |\n  t: 'a' # b\n"
    rows = [("a", "# c\nname: x # y\nlist:\n- 1\nmap: {a: 1}\n\n"), ("b", many), ("c", None), ("d", "no keys\n- at all")]
    got = {}
    for r in notations.yaml_outline(spark.createDataFrame(rows, "path string, content string")).collect():
        got.setdefault(r.path, []).append(r)
    assert [(r.key, r.value, r.n_items, r.start_line, r.end_line) for r in sorted(got["a"], key=lambda r: r.ord)] == [("name", "x", 0, 2, 2), ("list", None, 0, 3, 4), ("map", None, 0, 5, 7)]
    b = sorted(got["b"], key=lambda r: r.ord)
    assert [r.key for r in b if r.depth == 2] == [f"k{i}" for i in range(20)] + ["t"] and sum(r.depth == 3 for r in b) == 20
    assert (b[0].n_keys, b[0].start_line, b[0].end_line) == (20, 1, 51) and b[-1].value == "'a'"
    assert set(got) == {"a", "b"}


def test_json_kinds(spark):
    rows = [(1, '{"a":"123","b":"[x","c":"true","d.e":5,"f":null,"g":[1,[2]],"h":{"x":{},"y":1},"i":1.5,"j":false,"k":""}'), (2, "[{\"b\":1,\"a\":2},3]"), (3, "{broken"), (4, None), (5, "7"), (6, "[]"), (7, "[1]"), (8, '{"a":1}}'), (9, "1,2"), (10, "")]
    d = spark.createDataFrame(rows, "id int, doc string")
    got = {(r.id, r.key): r.kind for r in notations.json_outline(d, "doc", "id").collect()}
    assert got == {(1, "a"): "string", (1, "b"): "string", (1, "c"): "string", (1, "d.e"): "number", (1, "f"): "object", (1, "g"): "array[2]", (1, "h"): "object{2 keys}", (1, "i"): "number", (1, "j"): "boolean", (1, "k"): "string"}
    shape = {r.id: (r.kind, r.item_keys) for r in notations.json_shape(d, "doc", "id").collect()}
    assert shape == {1: ("object{10 keys}", None), 2: ("array[2]", ["a", "b"]), 3: (None, None), 4: (None, None), 5: ("number", None), 6: ("array[0]", None), 7: ("array[1]", None), 8: (None, None), 9: (None, None), 10: (None, None)}


@pytest.mark.parametrize(("path", "ok"), [
    ("/r/a", True), ("/r", True), ("/r/", True), ("/r/../x", False), ("/rx/a", False), ("/r/b/../c", True), ("/etc/passwd", False), ("a/b", True), ("../r/a", True), ("../x", False), ("", True), (None, False),
    ("/r/" + "a/" * 13 + "../" * 14 + "etc", False), ("/r/" + "a/" * 40 + "../" * 40 + "etc", True), ("/../../r/a", True), ("/r/./.././etc", False), ("/r//..//etc", False),
])
def test_inside(spark, path, ok):
    assert spark.createDataFrame([(path,)], "p string").select(gates.inside(F.col("p"), "/r")).first()[0] is ok


def test_cache_key(spark):
    rows = [
        ('{"b":"2","a":"1"}', '{"a":"1","b":"2"}'), ("{}", "{}"), ('{"a":"x\\":\\"y"}', '{"a":"x\\":\\"y"}'), ('{"z":{"y":1,"z":2,"a":3},"a":[{"z":1,"q":2},null,true]}', '{"a":[{"z":1},null,true],"z":{"a":3,"z":2}}'),
        ('{"n":1.0,"m":1e21,"k":0.0000001,"é":"\\u0007\\n"}', '{"k":1e-7,"m":1e+21,"n":1,"é":"\\u0007\\n"}'), ('{"a":1,"a":2}', '{"a":2}'),
    ]
    d = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)] + [(90, "[1]"), (91, "{"), (92, None)], "i int, a string")
    got = {r.i: r.k for r in d.select("i", notations.cache_key(F.lit("t"), F.col("a")).alias("k")).collect()}
    for i, (_, want) in enumerate(rows):
        assert got[i] == "t:" + hashlib.sha256(want.encode()).hexdigest()[:16], want
        json.loads(want)
    assert got[90] is got[91] is got[92] is None
