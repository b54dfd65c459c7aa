"""Canonical relations over the driver's star-schema tables.

The mapping is synthetic: the tables hold no source code and no telemetry, so their columns stand in
for tool calls, hook events, references, commits and files to exercise the operators. Every view is
one SQL text that Spark and DuckDB both accept, but for the few functions named in DIALECT.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans.spread import parts_of, spread

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Function spellings that differ: {name} in a view's text -> (Spark, DuckDB).
DIALECT = {
    "K": ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"),
    "TSMS": ("CAST(unix_millis(CAST(ts AS TIMESTAMP)) AS BIGINT)", "CAST(epoch_us(ts) // 1000 AS BIGINT)"),
    "STR": ("STRING", "VARCHAR"),
    "MTIME": ("CAST(unix_millis(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT)", "CAST(epoch_us(o_orderdate) // 1000 AS BIGINT)"),
}

VIEWS = {
    "tool_calls": """
        SELECT event_id, {TSMS} AS ts, CAST(user_id AS {STR}) AS session_id,
               CASE {K} % 10 WHEN 0 THEN 'smart_read' WHEN 1 THEN 'read_symbol' WHEN 2 THEN 'find_usages' WHEN 3 THEN 'smart_read_many'
                    WHEN 4 THEN 'smart_diff' WHEN 5 THEN 'test_summary' WHEN 6 THEN 'read_for_edit' WHEN 7 THEN 'code_audit'
                    WHEN 8 THEN 'project_overview' ELSE 'read_range' END AS tool,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('f', CAST(event_id % 97 AS {STR})) END AS path,
               CAST(floor(value) AS BIGINT) AS tokens_returned, {K} * 10 AS tokens_would_be,
               CASE {K} % 5 WHEN 0 THEN 'compression' WHEN 1 THEN 'cache' WHEN 2 THEN 'dedup' WHEN 3 THEN 'none' ELSE NULL END AS savings_category,
               {K} % 6 = 0 AS session_cache_hit, {K} % 7 = 0 AS delegated
        FROM events""",
    "hook_events": """
        SELECT event_id, {TSMS} AS ts, CAST(user_id AS {STR}) AS session_id,
               CASE WHEN {K} % 6 = 0 THEN NULL ELSE concat('agent', CAST({K} % 3 AS {STR})) END AS agent_type,
               CASE WHEN event_id % 5 = 0 THEN 'task' WHEN event_id % 3 = 0 THEN 'denied' ELSE 'allowed' END AS event,
               concat('f', CAST(event_id % 97 AS {STR})) AS file, {K} * 10 AS est_tokens, CAST(floor(value) AS BIGINT) AS summary_tokens,
               greatest(0, {K} * 10 - CAST(floor(value) AS BIGINT)) AS saved_tokens,
               concat('sub', CAST({K} % 4 AS {STR})) AS subagent_type,
               CASE WHEN {K} % 8 = 0 THEN '' WHEN {K} % 2 = 0 THEN concat('sub', CAST({K} % 4 AS {STR})) ELSE concat('sub', CAST(({K} + 1) % 4 AS {STR})) END AS matched_agent,
               CASE WHEN {K} % 10 = 9 THEN NULL ELSE concat('wf', CAST({K} % 9 AS {STR})) END AS workflow_id,
               value > 400 AS over_budget, concat('code', CAST({K} % 14 AS {STR})) AS code, concat('hook', CAST({K} % 3 AS {STR})) AS hook, {K} AS k
        FROM events""",
    "log_files": """
        SELECT o_orderkey AS id, {MTIME} AS mtime, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders""",
    "files": """
        SELECT doc_id, concat(source, '/', lang, '/doc_', CAST(doc_id AS {STR}), '.txt') AS path, lang AS language, text AS content FROM documents""",
    "refs": """
        SELECT symbol, path, line, CASE WHEN rn = 1 THEN 'definition' WHEN flag = 'A' THEN 'import' ELSE 'usage' END AS section, flag
        FROM (SELECT concat('s', CAST(l_partkey AS {STR})) AS symbol, concat('src', CAST(l_orderkey % 7 AS {STR}), '/o', CAST(l_orderkey AS {STR}), CASE l_orderkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.go' END) AS path,
                     l_linenumber AS line, min(l_returnflag) AS flag,
                     row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn
              FROM lineitem GROUP BY l_partkey, l_orderkey, l_linenumber) r""",
    "module_deps": """
        SELECT module, dep, n, CASE WHEN n % 2 = 0 THEN 'api' ELSE 'impl' END AS kind
        FROM (SELECT c_nationkey AS module, s_nationkey AS dep, count(*) AS n
              FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
              WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) e""",
    "commits": """
        SELECT o_orderkey AS id, concat('c', CAST(o_orderkey AS {STR})) AS hash, concat('dev', CAST(o_custkey % 50 AS {STR})) AS author, CAST(o_orderdate AS DATE) AS day,
               concat(CASE o_orderkey % 23 WHEN 0 THEN 'feat: new ' WHEN 1 THEN 'fix(core): ' WHEN 2 THEN 'refactor! split ' WHEN 3 THEN 'docs: ' WHEN 4 THEN 'tests: more '
                        WHEN 5 THEN 'chore: ' WHEN 6 THEN 'style: ' WHEN 7 THEN 'perf: ' WHEN 8 THEN 'v1.2 ' WHEN 9 THEN 'A Hotfix for ' WHEN 10 THEN 'update coverage of '
                        WHEN 11 THEN 'rename ' WHEN 12 THEN 'Readme ' WHEN 13 THEN 'implement ' WHEN 14 THEN 'lint ' WHEN 15 THEN 'optimizing ' WHEN 16 THEN 'faster ' WHEN 17 THEN 'fast '
                        WHEN 18 THEN 'bump ' WHEN 19 THEN 'CI ' WHEN 20 THEN 'prefix ' WHEN 21 THEN 'feature' ELSE 'misc ' END, o_orderpriority) AS message
        FROM orders""",
    "numstat": """
        SELECT l_orderkey AS id, concat('p', CAST(l_partkey % 40 AS {STR})) AS path, CASE WHEN l_returnflag = 'R' THEN '-' ELSE CAST(CAST(l_quantity AS BIGINT) AS {STR}) END AS ins,
               CASE WHEN l_returnflag = 'R' THEN '-' ELSE CAST(l_linenumber AS {STR}) END AS del FROM lineitem""",
    "symbols": """
        SELECT l_orderkey AS path, concat('sym', CAST(l_partkey % 5 AS {STR})) AS name, l_linenumber * 10 AS start_line, l_linenumber * 10 + CAST(l_quantity AS INT) % 17 AS end_line
        FROM lineitem WHERE l_returnflag = 'N'""",
    "hunks": """
        SELECT l_orderkey AS path, l_linenumber * 10 + l_partkey % 9 AS new_start, CAST(l_quantity AS BIGINT) % 6 AS new_count, l_tax > 0.03 AS has_added, l_discount > 0.05 AS has_removed
        FROM lineitem WHERE l_returnflag <> 'N'""",
}


def _render(sql: str, engine: int) -> str:
    for k, v in DIALECT.items():
        sql = sql.replace("{" + k + "}", v[engine])
    return sql


def duck(*names: str) -> str:
    """WITH clause that defines the views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({_render(VIEWS[n], 1)})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The canonical relation as a DataFrame; the tables are bound as query parameters, no catalog entry is made."""
    sql = _render(VIEWS[name], 0)
    used = [t for t in TABLES if f" {t}" in sql.replace("\n", " ")]
    for t in used:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}").replace(f"JOIN {t}", "JOIN {" + t + "}")
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})


#: In texts of our own that each customer gets, this stands for the customer's key; ids of theirs are key * IDS + id.
KEY_MARK, IDS = "§", 1000


def per_customer(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str, paths: tuple[str, ...] = (), ids: tuple[str, ...] = ()) -> DataFrame:
    """Rows of our own once for each customer, as a project of theirs: paths lie in the customer's folder, ids and texts bear the key.

    They are dealt to tasks by their number, as the customers' keys are few bytes; rows with paths by path, so that what goes by files moves no lines.
    """
    names = [x.split()[0] for x in re.split(r", (?![^<]*>)", schema)]
    made = F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in re.split(r', (?![^<]*>)', schema))}>>")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_k"))
    n = customers.count() * len(rows)
    customers = spread(customers, "_k", rows=n) if parts_of(n) > 1 else customers
    d = customers.select("_k", F.inline(made))
    kinds = dict(d.dtypes)
    key = F.col("_k").cast("string")
    marked = lambda c: F.replace(c, F.lit(KEY_MARK), key)
    own = {n: F.concat(F.lit("c"), key, F.lit("/"), marked(F.col(n))) for n in paths}
    own |= {n: F.col("_k") * IDS + F.col(n) for n in ids}
    own |= {n: marked(F.col(n)) for n in names if kinds[n] == "string" and n not in own}
    d = d.select(*[own.get(x, F.col(x)).alias(x) for x in names])
    return spread(d, *paths, rows=n) if paths and parts_of(n) > 1 else d


def per_customer_sql(sql: str, paths: str = "", ids: str = "", texts: str = "") -> str:
    """The same of the rows of a SELECT, for DuckDB; columns as lists with commas."""
    split = lambda x: [c.strip() for c in x.split(",") if c.strip()]
    own = [f"'c' || _k || '/' || replace({c}, '{KEY_MARK}', CAST(_k AS VARCHAR)) AS {c}" for c in split(paths)]
    own += [f"_k * {IDS} + {c} AS {c}" for c in split(ids)] + [f"replace({c}, '{KEY_MARK}', CAST(_k AS VARCHAR)) AS {c}" for c in split(texts)]
    return f"SELECT * EXCLUDE (_k) REPLACE ({', '.join(own)}) FROM ({sql}) _t, (SELECT c_custkey AS _k FROM customer)"
