"""Two-tree Lloyd, fill-in-middle and SimHash against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestrata.llm import centroids, infill, simhash
from lodestrata.llm.common import components

CLASHING = ("t", "w", "n", "id", "i", "chunk", "print", "own", "pop", "cluster", "vector", "size", "stripe", "near")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


# --- two-tree Lloyd


def _lloyd(rows, k, rounds):
    """The contract in plain Python: rows (vec_id, vector)."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"2:{i}".encode()).hexdigest())
    c = [list(v) for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in enumerate(c))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(c)):
            own = [v for (_, v), m in zip(kept, at, strict=True) if m == n]
            if own:
                c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = [(i, *nearest(v)) for i, v in kept]
    per = {n: sum(d for _, d, m in got if m == n) for n in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    return [(i, m, d, per[m], sum(per.values()), sha[m]) for i, d, m in got]


def _vectors(rng, n):
    middles = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    return [[rng.gauss(m, 0.05) for m in rng.choice(middles)] for _ in range(n)]


def _compare(spark, rows, k, rounds):
    d = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = sorted((tuple(r) for r in centroids.lloyd(d, k, rounds).collect()), key=repr)
    assert got == sorted(_lloyd(rows, k, rounds), key=repr)


def test_lloyd(spark):
    rng = random.Random(5)
    rows = list(enumerate(_vectors(rng, 300)))
    hot = [1 / 256] * 64
    rows += [(1000 + i, hot) for i in range(150)] + [(7, hot), (7, hot), (None, hot), (None, rows[3][1])]  # a third of all alike; repeated and null ids
    rows += [(2000, None), (2001, []), (2002, [0.0] * 63), (2003, [0.0] * 65), (2004, [None] + [0.0] * 63), (2005, [math.nan] + [0.0] * 63), (2006, [math.inf] * 64), (2007, [-math.inf] * 64)]
    _compare(spark, rows, 12, 3)


def test_lloyd_ties_and_few(spark):
    flat = lambda a, b: [float(a), float(b)] + [0.0] * 62
    rows = [(i, flat(x, y)) for i, (x, y) in enumerate([(-1, 0), (1, 0), (0, 0), (0, 1), (0, -1), (0, 0), (0.5, 0.5), (-0.5, -0.5)])]
    for k in (1, 2, 4, 8, 40):  # 40: more centroids than vectors
        _compare(spark, rows, k, 5)
    assert centroids.lloyd(spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")).count() == 0
    assert centroids.lloyd(spark.createDataFrame([], "vec_id long, embedding array<float>")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_lloyd_large_components(spark):
    rows = [(i, [float(rng) * 1e6, -3.5e5] + [float(i % 3)] * 62) for i, rng in enumerate([1, 2, 3, 50, 51, 52, 900, 1, 2])]
    _compare(spark, rows, 3, 4)
    rows = spark.createDataFrame([(1, [1e15] * 64), (2, [-1e15] * 64), (3, [1e300] * 64)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in centroids.lloyd(rows, 1, 2).collect()}
    assert set(got) == {1, 2} and got[1].distance == centroids.LONG and got[1].inertia == centroids.LONG


@pytest.mark.parametrize("kind", ["near", "flat", "line", "equal", "one"])
def test_cover_tree(kind):
    rng = np.random.default_rng(3)
    x = {"near": lambda: np.repeat(rng.normal(size=(12, 8)) * 100, 20, axis=0) + rng.normal(size=(240, 8)), "flat": lambda: rng.normal(size=(200, 64)), "line": lambda: np.arange(100.0)[:, None] ** 2, "equal": lambda: np.ones((50, 4)), "one": lambda: np.ones((1, 4))}[kind]()
    t = centroids.cover_tree(x)
    assert sorted(t.order) == list(range(len(x)))
    y = x[t.order]
    for k in range(len(t.centre)):
        inside = np.linalg.norm(y[t.start[k] : t.end[k]] - y[t.centre[k]], axis=1)
        assert t.start[k] <= t.centre[k] < t.end[k] and inside.max() <= t.radius[k] + 1e-4
        kids = range(t.first[k], t.last[k])
        if kids:
            assert t.start[kids[0]] == t.start[k] and t.end[kids[-1]] == t.end[k] and t.centre[k] in t.centre[list(kids)]
            scale = 2.0 ** (math.ceil(math.log2(max(np.linalg.norm(y[t.centre[c]] - y[t.centre[k]]) for c in kids))) - 1)
            mids = y[t.centre[list(kids)]]
            gaps = np.linalg.norm(mids[:, None] - mids[None], axis=2) + np.eye(len(mids)) * 1e9
            assert gaps.min() > scale / 2 * 0.999


def test_pairs_are_pruned():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(20, 64)) * 1000
    x = np.floor(np.repeat(middles, 50, axis=0) + rng.normal(size=(1000, 64)) * 10).astype(np.int64)
    c = [[int(v) for v in m] for m in middles]
    t, ct = centroids.cover_tree(x.astype(float)), centroids.cover_tree(np.array(c, float))
    point, one = centroids.candidates(t, x[t.order].astype(float), ct, np.array(c, float)[ct.order])
    assert len(point) < 2 * len(x)  # of 20 for each
    got, d = centroids.assign(t, x[t.order], c, ct)
    brute = ((x[t.order][:, None] - np.array(c)[None]) ** 2).sum(2)
    assert (got == brute.argmin(1)).all() and d == brute.min(1).tolist()


# --- fill in the middle

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def _infilled(doc_id, text):
    text = text or ""
    u = TOKEN.findall(text)
    n = len(u)
    x = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (doc_id, n, "plain", None, None, text, sha(text), sha(text))
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = ("".join(u[p:q]) for p, q in ((0, i), (i, j), (j, n)))
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"
    return (doc_id, n, form, len(a), len(b), out, sha(out), sha(text))


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 16])
def test_infill(spark, chunk):
    rng = random.Random(chunk)
    texts = [None, "", " ", "a", " a", "a ", "  \t", "<P>", "a<S>b", "< P>", "<<M>", "<P<M", "é😀 ü x", "  a", "<", "<M", "a <P b> <S"]
    texts += ["".join(rng.choice("ab <PSM>é😀\n\t") for _ in range(rng.randint(1, 40))) for _ in range(120)]
    texts += ["".join(rng.choice("ab  é") for _ in range(60)) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, "a b c"), (3, "a b c"), (None, "x y z  "), (None, "x y z  "), (None, "3:a b c")] + [(77, "one two three four")] * 60
    got = sorted((tuple(r) for r in infill.infilled(clashing(spark.createDataFrame(rows, "doc_id long, text string")), chunk).collect()), key=repr)
    assert got == sorted((_infilled(*r) for r in rows), key=repr)


def test_infill_long_texts(spark):
    rng = random.Random(9)
    rows = [(i, ("word é " * 40_000 + "<" * rng.randint(1, 9)) * (i % 3) + " end" * i) for i in range(12)] + [(50, "x" * 300_000), (51, " " * 300_000), (52, "y " * 100_000 + "<P" + ">" * 70_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in infill.op12(d).collect()}
    for i, text in rows:
        e = _infilled(i, text)
        assert tuple(got[i]) == (*e[:5], *e[6:])
    assert infill.op12(d.limit(0)).count() == 0


def test_summaries_compose():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("a <PM>") for _ in range(rng.randint(0, 12))).encode()
        cuts = sorted(rng.randint(0, len(text)) for _ in range(3))
        a, b, c, d = (infill.summary(text[x:y]) for x, y in zip([0, *cuts], [*cuts, len(text)], strict=True))
        assert a.then(b).then(c.then(d)) == a.then(b.then(c)).then(d)
        assert a.then(b).then(c).then(d) == infill.summary(text)


# --- SimHash


def _print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def _roots(prints):
    p = sorted(set(prints))
    up = {v: v for v in p}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(p):
        for b in p[:i]:
            if (a ^ b).bit_count() <= 3:
                up[top(a)] = top(b)
    return {v: top(v) for v in p}


def test_simhash(spark):
    rng = random.Random(8)
    words = [f"Word{i}é" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for i in range(100)]
    for i in range(20):  # near copies, and a third of all rows alike
        base = [rng.choice(words) for _ in range(600)]
        rows += [(200 + 20 * i + j, " ".join(base[:j] + ["NEW"] + base[j + 1 :])) for j in range(8)]
    rows += [(1000 + i, "The Same  text\tagain and again") for i in range(130)] + [(999, "the same text again and again"), (5000, None), (5001, " \n"), (5002, ""), (5003, "ONE"), (5004, "one two"), (5, "x y z"), (5, "x y z"), (None, "x  y z"), (None, None), (6000, "w " * 200_000)]
    got = simhash.near_copies(clashing(spark.createDataFrame(rows, "doc_id long, text string")), 64, 8).collect()
    assert len(got) == len(rows)
    root = _roots([_print(t) for _, t in rows])
    least = {}
    for i, t in rows:
        if i is not None:
            least[root[_print(t)]] = min(i, least.get(root[_print(t)], i))
    want = sorted(((i, f"{_print(t):016x}", least[root[_print(t)]]) for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert len(set(least.values())) < len(set(root))  # some fingerprints are near, not equal
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_copies(empty).count() == 0
    assert [tuple(r) for r in simhash.near_copies(spark.createDataFrame([(None, "a"), (None, "a")], "doc_id long, text string")).collect()] == [(None, f"{_print('a'):016x}", None)] * 2


@pytest.mark.parametrize(("group", "tile"), [(1 << 14, 4096), (64, 8), (16, 1)])
def test_fingerprint_links(spark, group, tile):
    rng = random.Random(group)
    prints = {0, 1, (1 << 64) - 1, 0xF, 7}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            prints.add(base)
            for _ in range(rng.randint(1, 3)):
                base ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    prints |= {centre ^ 1 << a ^ 1 << b for a in range(16) for b in range(16)}  # many of one stripe and of one population count
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in prints], "print long")
    edges = simhash.links(nodes, group, tile)
    assert all(((r.a ^ r.b) & (1 << 64) - 1) in range(1 << 64) for r in edges.collect())
    got = {}
    for r in components(edges).collect():
        got.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
    want = {}
    for v, top in _roots(prints).items():
        want.setdefault(top, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)
