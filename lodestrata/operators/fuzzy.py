"""Fuzzy search of names: halves of names, what deletions leave of them, and a bounded edit distance; no pair is made that is not near.

However a query is edited into a name, some cut of the query parts the edits: what lies before it becomes the name's left half, what lies
behind it the right one, and the edits of both sum up. Left halves are few where names begin alike, and are compared once for each
beginning that a query has. The right half and what lies behind the cut meet where the left half is equal and both are alike after as many
deletions as edits are left, of which short texts have few. So a name is entered by its right half alone, under its left half,
and a query asks only for what has nearly all of its characters, however common any of them are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.plans.spread import ROWS, parts_of, spread, unbroadcast

#: Edits allowed.
EDITS = 2
#: Names of a part of a key: keys of more are dealt to several parts.
POSTINGS = 1 << 16
#: Rows of an index that a task compares: each meets several queries.
PER_TASK = 8 * ROWS


def _deletions(name: Column, edits: int) -> Column:
    """What is left of a name after up to so many deletions, itself included."""
    found = F.array(name)
    for _ in range(edits):
        cut = lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.char_length(x)), lambda i: i > 0), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.char_length(x))))  # noqa: E731, B023
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, cut))))
    return found


def _half(length: Column) -> Column:
    """Characters of the left half of a name of so many."""
    return F.ceil(length / 2).cast("int")


def name_index(names: DataFrame, edits: int = EDITS, most: int = POSTINGS) -> DataFrame:
    """Entries (key, part, cut, left, right) of distinct names (name), a name being left and right: one for each text that up to so many
    deletions (cut) leave of the right half. key is a hash of the left half and that text; what meets by it is compared.

    Names of a key that very many have are numbered into parts from 0, so no task holds a common one.
    """
    d = names.select("name").where("name is not null").distinct()
    n = _half(F.char_length("name"))
    d = spread(d.select(F.substring("name", F.lit(1), n).alias("left"), F.substring("name", n + 1, F.char_length("name")).alias("right")))
    every = d.select("left", "right", F.explode(_deletions(F.col("right"), edits)).alias("rest"))
    every = every.select(F.xxhash64("left", "rest").alias("key"), (F.char_length("right") - F.char_length("rest")).alias("cut"), "left", "right")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("right", "left"))
    return every.select("key", F.floor((nth - 1) / most).cast("int").alias("part"), "cut", "left", "right")


def _beginnings(parts: DataFrame, lefts: DataFrame, edits: int) -> DataFrame:
    """(head, left, spent): the left halves within so many edits of each head."""
    a = parts.select("head", F.explode(_deletions(F.col("head"), edits)).alias("rest"))
    b = lefts.select("left", F.explode(_deletions(F.col("left"), edits)).alias("rest"))
    met = unbroadcast(a).join(unbroadcast(b), "rest").select("head", "left").distinct()
    return met.withColumn("spent", F.levenshtein("head", "left", edits)).where("spent >= 0")


def fuzzy_search(queries: DataFrame, index: DataFrame, edits: int = EDITS) -> DataFrame:
    """(id, query, name, distance) of the names of an index within so many edits of each query (id, query); the index is one of as many edits. Null queries find nothing."""
    q = queries.select("id", "query").where("query is not null").distinct()
    n = parts_of(index.count(), PER_TASK)
    size = F.char_length("query")
    # a left half has about half of a name's characters, and the name as many as the query, but for the edits
    lo, hi = F.greatest(F.lit(0), _half(F.greatest(F.lit(0), size - edits)) - edits), F.least(size, _half(size + edits) + edits)
    cuts = q.select("query").distinct().select("query", F.explode(F.sequence(lo, hi)).alias("_at"))
    cuts = cuts.select("query", F.substring("query", F.lit(1), F.col("_at")).alias("head"), F.substring("query", F.col("_at") + 1, size).alias("tail"))
    near = _beginnings(cuts.select("head").distinct(), index.where("cut = 0").select("left").distinct(), edits)
    cuts = unbroadcast(cuts).join(unbroadcast(near), "head").select("query", "tail", "left", "spent")
    # only as many deletions as edits are left
    asked = [cuts.where(F.col("spent") == e).select("*", F.explode(_deletions(F.col("tail"), edits - e)).alias("rest")) for e in range(edits + 1)]
    every = asked[0]
    for x in asked[1:]:
        every = every.unionByName(x)
    every = every.select("query", "tail", "spent", F.xxhash64("left", "rest").alias("key"), F.col("left").alias("_left"))
    # a query goes to every part of its keys
    more = index.where("part > 0").groupBy("key").agg(F.max("part").alias("last"))
    every = unbroadcast(every).join(unbroadcast(more), "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0))))).drop("last")
    met = unbroadcast(every.repartition(n, "key", "part")).join(unbroadcast(index.repartition(n, "key", "part")), ["key", "part"])
    met = met.where((F.col("left") == F.col("_left")) & (F.col("cut") + F.col("spent") <= edits)).withColumn("_e", F.levenshtein("tail", "right", edits)).where((F.col("_e") >= 0) & (F.col("_e") + F.col("spent") <= edits))
    met = met.select("query", F.concat("left", "right").alias("name"), (F.col("_e") + F.col("spent")).alias("distance"))
    # the best cut of a pair makes its distance
    found = met.repartition(n, "query").groupBy("query", "name").agg(F.min("distance").alias("distance"))
    return unbroadcast(q).join(unbroadcast(found), "query").select("id", "query", "name", "distance")


def best(matches: DataFrame, limit: int) -> DataFrame:
    """The nearest names of each query, ties by name, with their rank. Matches of one query are ranked in one task: within few edits they are few."""
    w = Window.partitionBy("id").orderBy("distance", "name")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
