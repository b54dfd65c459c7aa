"""Structural search against a version that tries all runs."""

import itertools
import random

import pytest

from lodestrata.operators import patterns as p


def _flat(nodes):
    return [(n.text, None if n.inner is None else _flat(n.inner)) for n in nodes]


def _brute(pattern, nodes):
    """Per place the match with the least run lengths in the order of the holes: all lengths of all holes are tried."""

    def ways(pat, ns, whole):
        """(taken, lengths, bindings as pairs) for every choice of run lengths on this level and those inside."""
        holes = [i for i, (t, inner) in enumerate(pat) if inner is None and t.startswith("$")]
        for sizes in itertools.product(range(len(ns) + 1), repeat=len(holes)):
            at, ok, parts, lens = 0, True, [], iter(sizes)
            for t, inner in pat:
                if inner is None and t.startswith("$"):
                    k = next(lens)
                    run = ns[at : at + k]
                    if len(run) < k or (not t.startswith("$$$") and (not k or any(x in ((",", None), (";", None)) for x in run))):
                        ok = False
                        break
                    parts.append([((k,), [(t.lstrip("$"), run)])])
                    at += k
                elif at < len(ns) and ns[at][0] == t and (ns[at][1] is None) == (inner is None):
                    if inner is not None:
                        parts.append([(lens_, b) for _, lens_, b in ways(inner, ns[at][1], True)])
                    at += 1
                else:
                    ok = False
                    break
            if ok and (not whole or at == len(ns)):
                for choice in itertools.product(*parts):
                    yield at, tuple(x for c in choice for x in c[0]), [x for c in choice for x in c[1]]

    def consistent(bound):
        seen = {}
        return all(not n or seen.setdefault(n, run) == run for n, run in bound)

    out = []
    for at in range(len(nodes)):
        fits = [(lens, end, b) for end, lens, b in ways(pattern, nodes[at:], False) if end and consistent(b)]
        if fits:
            lens, end, b = min(fits, key=lambda f: f[0])
            out.append((nodes[at : at + end], {n: run for n, run in b if n}))
        if nodes[at][1] is not None:
            out += _brute(pattern, nodes[at][1])
    return out


@pytest.mark.parametrize("pattern", ["f($A)", "f($A, $$$)", "f($$$ARGS)", "$A == $A", "if ($$$C) { $$$ }", "[$X, $X]", "$F($$$A, x, $$$B)", "a $$$ b", "($A)", "$A.f($$$)"])
def test_against_all_runs(pattern):
    rng = random.Random(pattern)
    wanted = p.tree(pattern, pattern=True)
    hits = 0
    for _ in range(500):
        text = " ".join(rng.choice(["f (", "( ", ")", "[", "]", "{", "}", ",", "a", "b", "x", "==", "if (", ". f (", "a == a", "if ( a ) { x }", "f ( a b , x , x , b )", "[ a , a ]", "[ f ( x ) , f ( x ) ]"]) for _ in range(rng.randint(1, 8)))
        nodes = p.tree(text)
        if max([len(nodes), *[len(n.inner) for n in nodes if n.inner]]) > 7:
            continue
        got = []
        for start, end, bound in p.found(wanted, nodes):
            got.append((_flat(p.tree(text[start:end])), {k: _flat(v) for k, v in bound.items()}))
        want = _brute(_flat(wanted), _flat(nodes))
        assert [g[1] for g in got] == [w[1] for w in want], text
        assert [len(g[0]) for g in got] == [len(w[0]) for w in want], text
        hits += len(want)
    assert hits


def test_tokens_and_groups():
    t = p.tree('f("a)b", \'(\', `{`, // g(\n x /* ) */ [1.5e3, y]) } z')
    assert _flat(t) == [("f", None), ("(", [('"a)b"', None), (",", None), ("'('", None), (",", None), ("`{`", None), (",", None), ("x", None), ("[", [("1.5e3", None), (",", None), ("y", None)])]), ("}", None), ("z", None)]
    assert _flat(p.tree("x = '''a\n(''' # f(\ny", hashes=True)) == [("x", None), ("=", None), ("'''a\n('''", None), ("y", None)]
    assert _flat(p.tree("(a [b )")) == [("(", [("a", None), ("[", [("b", None)])])]
    assert _flat(p.tree("f($A, $$$REST, $$$)", pattern=True)) == [("f", None), ("(", [("$A", None), (",", None), ("$$$REST", None), (",", None), ("$$$", None)])]
    assert p.tree("") == () and p.literal_words("foo($A, bar.$B, $$$)") == ["bar", "foo"]


def test_search_reads_candidates_only(spark):
    rows = [
        ("a.ts", "// call(1)\nfunction f() {\n  return call(a + b,\n    [1, 2], 'x');\n}\n"), ("b.ts", "call()\nother(call(1))"), ("c.py", "# call(0)\ncall(x)  # call(2)\nz = '''call(3)'''"), ("d.ts", "nothing"), ("e.ts", None), ("f.ts", ""),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    index = p.word_index(files)
    assert sorted(r.path for r in p.candidates(index, "call($A)").collect()) == ["a.ts", "b.ts", "c.py"]
    got = sorted((r.path, r.line, r.end_line, r.text, r.bindings) for r in p.structural_search(files, index, "call($A, $$$MORE)").collect())
    assert got == [("a.ts", 3, 4, "call(a + b,\n    [1, 2], 'x')", {"A": "a + b", "MORE": "[1, 2], 'x'"})]
    got = sorted((r.path, r.line, r.bindings["A"]) for r in p.structural_search(files, index, "call($A)").collect())
    assert got == [("b.ts", 2, "1"), ("c.py", 2, "x")]
    assert p.structural_search(files, index, "call($A)", ".py").count() == 1
    assert p.structural_search(files, index, "$A = $B").count() == 3  # no word: all files are read; a run may begin at each node
    assert p.structural_search(files.limit(0), index.limit(0), "call($A)").count() == 0
    with pytest.raises(ValueError, match="token"):
        p.structural_search(files, index, " // x")
