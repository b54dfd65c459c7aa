"""Work is dealt by rows, and no side of a join that its file makes look small is sent whole to all."""

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import fuzzy, project, structure
from lodestrata.plans.spread import parts_of, spread
from lodestrata.queries import QUERIES
from lodestrata.sources.adapters import per_customer


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A table of customers of few bytes in one file."""
    at = str(tmp_path_factory.mktemp("many"))
    spark.range(20_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{at}/customer.parquet")
    return at


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_customers_are_dealt_by_their_number(spark, many):
    rows = [(f"a{i}", i) for i in range(10)]
    assert per_customer(spark, many, rows, "path string, id int").rdd.getNumPartitions() == parts_of(200_000) == 7
    d = per_customer(spark, many, rows, "path string, id int", ("path",))
    assert d.rdd.getNumPartitions() == 7 and d.count() == 200_000
    assert spread(d, "path", rows=1).rdd.getNumPartitions() == 1


def test_symbols_move_no_lines(spark, many):
    """Of files that lie by path: the keys and the files are dealt once for each language, and no window or join deals lines again."""
    for name, dealt in (("p01_p02_symbols", 4), ("t02_read_symbol", 6)):
        assert _plan(QUERIES[name](spark, many)).count("Exchange") == dealt


@pytest.mark.parametrize("name", ["j06_resolved_imports", "j06_resolved_files", "t02_read_symbol", "b09_symbol_resolution", "t19_diff_report", "j05_decorators", "p09_tiered", "p08_head_tail"])
def test_nothing_is_broadcast(spark, many, name):
    if name == "p08_head_tail":
        spark.createDataFrame([(1, "s", "l", "a\nb")], "doc_id long, source string, lang string, text string").write.mode("overwrite").parquet(f"{many}/documents.parquet")
    assert "Broadcast" not in _plan(QUERIES[name](spark, many))


def test_searches_broadcast_nothing(spark):
    names = spark.createDataFrame([("parse",), ("parser",)], "name string")
    assert "Broadcast" not in _plan(fuzzy.fuzzy_search(names.select(F.lit(1).alias("id"), F.col("name").alias("query")), fuzzy.name_index(names)))
    paths = names.withColumnRenamed("name", "path")
    assert "Broadcast" not in _plan(project.matching_paths(paths, paths))


def test_a_name_of_many_bearers_meets_those_that_ask_for_it_once(spark):
    syms = spark.createDataFrame([(f"f{i}", "ready", None, i) for i in range(50)] + [("g", "ready", "Engine", 3)], "path string, name string, parent string, start_line int")
    asked = spark.createDataFrame([("Engine.ready",), ("Other.ready",), ("none",), ("ready",)], "asked string")
    found = structure.resolved(asked, syms)
    assert _plan(found).count("Join") == 1
    assert sorted(map(tuple, found.collect())) == [("Engine.ready", "g", 3), ("Other.ready", "f0", 0), ("ready", "f0", 0)]


def test_files_of_orders_are_dealt_by_their_number(spark, tmp_path):
    """Each order's file is a row of some hundred bytes: one order is a row, whatever the bytes that its lines take."""
    spark.range(70_000).selectExpr("id as o_orderkey", "id as o_custkey", "'F' as o_orderstatus").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(70_000).selectExpr("id as l_orderkey", "1 as l_linenumber", "2.0 as l_quantity", "id as l_partkey").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("s06_yaml_outline", "p04_python_methods", "p05_php_methods"):
        d = QUERIES[name](spark, str(tmp_path))
        assert d.rdd.getNumPartitions() == parts_of(70_000) == 3, name
        assert "Broadcast" not in _plan(d)


def test_a_report_of_diffs_is_dealt_by_rows(spark, many):
    """No exchange is left to Spark, which deals by bytes: lines of diffs are few bytes."""
    plan = _plan(QUERIES["t19_diff_report"](spark, many))
    assert "Exchange" in plan and "ENSURE_REQUIREMENTS" not in plan


@pytest.mark.parametrize("name", ["c01_file_diffs", "c01_hunks"])
def test_lines_of_diffs_are_dealt_by_rows(spark, many, name):
    d = QUERIES[name](spark, many)
    assert "ENSURE_REQUIREMENTS" not in _plan(d) and d.rdd.getNumPartitions() == parts_of(80_000) == 3
