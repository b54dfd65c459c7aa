"""Routes, ways and ranks against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.operators import graph as g
from lodestrata.queries import QUERIES


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "module long, dep long")


def _simple(pairs, start, goal, most):
    out, open_ = [], [(start,)]
    while open_:
        path = open_.pop()
        if path[-1] == goal:
            out.append((len(path) - 1, ">" + ">".join(map(str, path)) + ">"))
        elif len(path) <= most:
            open_ += [(*path, b) for a, b in pairs if a == path[-1] and b not in path]
    return sorted(out)


@pytest.mark.parametrize(("seed", "most", "depth"), [(1, 50, 6), (2, 3, 6), (3, 5, 3), (4, 1000, 7)])
def test_routes(spark, seed, most, depth):
    rng = random.Random(seed)
    pairs = sorted({(rng.randint(0, 11), rng.randint(0, 11)) for _ in range(26)})
    want = [(p, d) for d, p in _simple(pairs, 0, 11, depth)][:most]
    got = [tuple(r) for r in g.routes(spark, _edges(spark, pairs + pairs[:3]), 0, 11, depth, most).collect()]
    assert got == want


def test_unreachable_goal_in_a_dense_graph(spark):
    dense = spark.range(320).alias("x").join(spark.range(320).alias("y"), how="cross").selectExpr("x.id as module", "y.id as dep").where("module <> dep")  # 10^5 edges
    pairs = dense.unionByName(_edges(spark, [(5000, 1)]))
    assert g.routes(spark, pairs, 0, 5000, 20).count() == 0
    rows = g.routes(spark, dense.unionByName(_edges(spark, [(7, 6000)])), 0, 6000, 20, 5).collect()
    assert [(r.path, r.depth) for r in rows] == [(">0>7>6000>", 2)] + [(f">0>{i}>7>6000>", 3) for i in sorted(range(1, 320), key=lambda i: f"{i}>") if i != 7][:4]
    assert g.routes(spark, dense, 3, 3).count() == 0


def test_call_tree_and_ways(spark):
    rng = random.Random(9)
    pairs = sorted({(a, b) for a, b in ((rng.randint(0, 7), rng.randint(0, 7)) for _ in range(24)) if a != b})
    want = set()
    open_ = [(0,)]
    while open_:
        path = open_.pop()
        for a, b in pairs:
            if b == path[-1] and a not in path and len(path) <= 4:
                want.add((a, ">" + ">".join(map(str, (*path, a))) + ">", len(path)))
                open_.append((*path, a))
    assert {tuple(r) for r in g.call_tree(spark, _edges(spark, pairs), 0, 4).collect()} == want
    m = np.zeros((8, 8), object)
    for a, b in pairs:
        m[a, b] = 1
    ways = {(r.node, r.depth): int(r.n) for r in g.walk_counts(_edges(spark, pairs), 0, 20).collect()}
    power = np.eye(8, dtype=object)
    for k in range(1, 21):
        power = m.dot(power)
        assert {n: int(power[n, 0]) for n in range(8) if power[n, 0]} == {n: c for (n, d), c in ways.items() if d == k}
    assert g.walk_counts(_edges(spark, [(1, 2)]), 7).count() == 0


def _dense(edges, seeds, restart):
    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | set(seeds))
    at = {n: i for i, n in enumerate(nodes)}
    p = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        p[at[a], at[b]] += w
    s = np.zeros(len(nodes))
    for n, w in seeds.items():
        s[at[n]] = w / sum(seeds.values())
    for i, total in enumerate(p.sum(1)):
        p[i] = p[i] / total if total else s
    x = s
    for _ in range(600):
        x = (1 - restart) * x @ p + restart * s
    return dict(zip(nodes, x, strict=True))


def test_ranks_of_many_queries(spark):
    rng = random.Random(11)
    edges = [(rng.randint(0, 19), rng.randint(0, 24), rng.choice([1.0, 2.0, 0.5])) for _ in range(60)]  # nodes 20 to 24 have no edges
    seeds = {"a": {0: 1.0}, "b": {3: 2.0, 22: 1.0}, "c": {99: 1.0}, "d": {n: 1.0 for n in range(20)}}
    rows = [(q, n, w) for q, s in seeds.items() for n, w in s.items()] + [("none", 1, 0.0)]
    got = {}
    ranks = g.ranked(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame(rows, "query string, node long, weight double"), restart=0.4)
    for r in ranks.collect():
        got.setdefault(r["query"], {})[r.node] = r.score
    assert set(got) == set(seeds)
    for q, s in seeds.items():
        want = _dense(edges, s, 0.4)
        assert sum(abs(got[q].get(n, 0.0) - v) for n, v in want.items()) < 1e-9
    best = g.top_ranked(ranks, 3).collect()
    for q in ("a", "b", "d"):
        mine = sorted(((-round(v, 6), n) for n, v in got[q].items()))[:3]
        assert [(r.node, r["rank"]) for r in sorted(best, key=lambda r: r["rank"]) if r["query"] == q] == [(n, i + 1) for i, (_, n) in enumerate(mine)]


@pytest.mark.parametrize(("files", "wide"), [(40, 1 << 21), (3000, 1 << 21), (40, 60)])
def test_near_ranks_are_the_ranks_of_the_whole_graph(spark, files, wide):
    """On graphs that one neighbourhood fills, that it does not, and with neighbourhoods that are too wide for a task."""
    rng = random.Random(files)
    pairs = sorted({(f"s{rng.randint(0, files // 2)}", f"f{i}") for i in range(files) for _ in range(3)})
    rows = [("one", "s1", 1.0), ("two", "s2", 1.0), ("two", "s3", 3.0), ("lost", "nowhere", 1.0), ("none", "s1", 0.0)]
    graph, seeds = spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(rows, "query string, node string, weight double")
    got = sorted(map(tuple, g.ranked_near(graph, seeds, 7, 0.5, wide=wide).select("query", "rank", "node", "score").collect()))
    nodes = {"one": {"s1": 1.0}, "two": {"s2": 1.0, "s3": 3.0}}
    edges = [(a, b, 1.0) for a, b in pairs] + [(b, a, 1.0) for a, b in pairs]
    at = {}
    for a, b, _ in edges:
        at.setdefault(a, []).append(b)
    want = [("lost", 1, "nowhere", 1.0)]
    for q, s in nodes.items():
        start = {n: w / sum(s.values()) for n, w in s.items()}
        x = start
        for _ in range(45):
            moved = {}
            for n, v in x.items():
                for m in at[n]:
                    moved[m] = moved.get(m, 0.0) + v / len(at[n]) / 2
            x = {n: moved.get(n, 0.0) + start.get(n, 0.0) / 2 for n in moved.keys() | start.keys()}
        best = sorted((-int(v * 1e6 + 0.5), n) for n, v in x.items())[:7]
        want += [(q, i + 1, n, -v / 1e6) for i, (v, n) in enumerate(best)]
    assert got == sorted(want)


def test_exploration_walks_no_whole_graph(spark, tmp_path, monkeypatch):
    spark.range(4000).selectExpr("id % 1000 as l_orderkey", "cast(id % 7 as int) as l_linenumber", "(id * 7919) % 900 as l_partkey", "'N' as l_returnflag").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(g, "ranked", None)
    rows = QUERIES["x07_ranked_exploration"](spark, str(tmp_path)).collect()
    assert {r["query"] for r in rows} == {"s0", "s400", "s800"} and all(r["node"] == r["query"] for r in rows if r["rank"] == 1)


def test_near_ranks_read_the_rim_that_matters():
    """After four whole steps only nodes that could change the best are read, and what is said to be certain is."""
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 5000, 160_000) * 2, rng.integers(0, 40_000, 160_000) * 2 + 1
    a, b = np.unique(np.stack([a, b]), axis=1)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    d = np.bincount(a, minlength=80_002)
    near = lambda v: b[np.searchsorted(a, v) : np.searchsorted(a, v, "right")]
    read = []
    for seed in (0, 400, 800, 1200):
        x = want = 0.5 * (np.arange(len(d)) == seed)
        for _ in range(45):
            x = 0.5 * np.bincount(b, (x / np.maximum(d, 1))[a], len(d))
            want = want + x
        told = [seed]
        for _ in range(3):
            told = sorted(set(told).union(*(near(v).tolist() for v in told)))
        while True:
            lists = [near(v) for v in told]
            t = pa.table({"query": ["q"] * len(told), "node": pa.array(told, pa.int64()), "s": [float(v == seed) for v in told], "near": pa.array(lists, pa.list_(pa.int64())), "sizes": pa.array([d[x] for x in lists], pa.list_(pa.int64()))})
            got = g._certain(t, 20, 0.5, 6, int(d.max()))
            if not got["score"].null_count:
                break
            assert not set(told) & set(got["node"].to_pylist())
            told += got["node"].to_pylist()
        read.append(sum(map(len, lists)))
        best = np.floor(want * 1e6 + 0.5)
        assert sorted(zip(got["node"].to_pylist(), np.floor(got["score"].to_numpy() * 1e6 + 0.5), strict=True)) == [(v, best[v]) for v in np.flatnonzero(best >= np.sort(best)[-20])]
    assert np.mean(read) < len(a) / 2
    assert g._certain(t.slice(0, 200), 20, 0.5, 6, int(d.max()), wide=300)["node"].to_pylist() == [None]
