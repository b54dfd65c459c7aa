"""Fuzzy search against the edit distance of all pairs."""

import random

import pytest

from lodestrata.operators import fuzzy


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, was = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[j - 1] + 1, was[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("edits", "most"), [(1, 1 << 16), (2, 1 << 16), (2, 3), (3, 5)])
def test_against_all_pairs(spark, edits, most):
    rng = random.Random(edits * 100 + most)
    make = lambda: "".join(rng.choice("abcAé😀_") for _ in range(rng.randint(0, 9)))
    names = sorted({make() for _ in range(150)} | {"aaaaaaaa", "aaaa", "aaaaa", "common_name", "common_nam", "commonname", "", "a", "ab"} | {f"common_{i}" for i in range(40)})
    queries = [make() for _ in range(25)] + ["common_name", "aaaaaa", "", "b", "common_7", None] + [rng.choice(names) for _ in range(5)]
    index = fuzzy.name_index(spark.createDataFrame([(n,) for n in names] + [(names[3],), (None,)], "name string"), edits, most)
    if most < 100:
        assert index.selectExpr("max(part)").first()[0] > 0
    q = spark.createDataFrame(list(enumerate(queries)) * 2, "id int, query string")
    got = sorted((r.id, r.name, r.distance) for r in fuzzy.fuzzy_search(q, index, edits).collect())
    assert got == sorted((i, n, d) for i, t in enumerate(queries) if t is not None for n in names if (d := _distance(t, n)) <= edits)
    plan = fuzzy.fuzzy_search(q, index, edits)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_best_and_empty(spark):
    index = fuzzy.name_index(spark.createDataFrame([("parse",), ("parser",), ("parsed",), ("purse",), ("x",)], "name string"))
    q = spark.createDataFrame([(1, "parse"), (2, "nothing")], "id int, query string")
    assert [(r.name, r.distance, r["rank"]) for r in fuzzy.best(fuzzy.fuzzy_search(q, index), 3).orderBy("rank").collect()] == [("parse", 0, 1), ("parsed", 1, 2), ("parser", 1, 3)]
    assert fuzzy.fuzzy_search(q.limit(0), index).count() == 0
    assert fuzzy.fuzzy_search(q, fuzzy.name_index(spark.createDataFrame([], "name string"))).count() == 0


def test_names_that_begin_alike_share_no_key(spark):
    """What all names have names no entries: a key's names are few, and the rows are those of all pairs."""
    names = [f"Customer#{i:09d}" for i in range(3000)]
    index = fuzzy.name_index(spark.createDataFrame([(n,) for n in names], "name string"))
    assert index.groupBy("key").count().selectExpr("max(count)").first()[0] < 700
    queries = [(1, "Customer#000000123"), (2, "Custmer#000002999"), (3, "ustomer#00000012"), (4, "Customer#000000123"), (5, "Customer")]
    got = sorted((r.id, r.name, r.distance) for r in fuzzy.fuzzy_search(spark.createDataFrame(queries, "id int, query string"), index).collect())
    assert got == sorted((i, n, d) for i, q in queries for n in names if (d := _distance(q, n)) <= 2)
