"""What the corpus operators share: scratch tables, hashing of words, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.plans.scratch import release, saved, scratch_dir, scratch_path

__all__ = ["release", "saved", "scratch_dir", "scratch_path"]

#: ASCII white space that separates words.
SPACES = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


#: Buckets of row hashes that are sent to every task; of a larger set of rows all buckets are sent.
BUCKETS = 1 << 20
#: Names of the two hashes that stand for a whole row.
ROW = ("_row1", "_row2")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df bears."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def row_hashes(docs: DataFrame) -> list[Column]:
    """Two hashes over all columns of a row, named ROW, by which it is found again. Columns with maps, which Spark does not hash, count as their JSON."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return [F.xxhash64(*cols).alias(ROW[0]), F.hash(*cols).alias(ROW[1])]


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose hashes stand in gone; of rows whose hashes stand in once, one stays.

    Most texts are not shuffled: a bounded set of hash buckets goes to every task, and only rows in one of
    them are joined. Columns may bear any name: each row travels as one struct.
    """
    d = docs.select(*row_hashes(docs), F.struct("*").alias("row"))
    place = F.pmod(F.col(ROW[0]), F.lit(BUCKETS)).alias("bucket")
    asked = gone.select(place) if once is None else gone.select(place).union(once.select(place))
    asked = F.broadcast(asked.distinct())
    d = d.withColumn("bucket", place)
    rest = d.join(asked, "bucket", "left_semi").join(gone.select(*ROW).distinct(), list(ROW), "left_anti")
    if once is not None:
        one = once.select(*ROW).distinct()
        # a row may hold a map, by which rows cannot be told apart: one of equal hashes is taken
        rest = rest.join(one, list(ROW), "left_anti").unionByName(rest.join(one, list(ROW), "left_semi").dropDuplicates(list(ROW)))
    return d.join(asked, "bucket", "left_anti").unionByName(rest).select("row.*")


#: A node is hot if it has so many edges, and one of HOT_NODES of all; the least neighbours of hot nodes, no more than HOT_NODES, are sent to every task.
HOT_DEGREE, HOT_NODES = 1 << 20, 4096


def _with_least(pairs: DataFrame, most: int) -> DataFrame:
    """(u, v, m): pairs (u, v) with the least of u and its neighbours v. most: at least the number of pairs. The many pairs of a hot node are not dealt by it."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    if most < HOT_DEGREE:  # no node can be hot
        return pairs.join(least.select("u", "m"), "u")
    hot = (F.col("n") >= HOT_DEGREE) & (F.col("n") * HOT_NODES >= most)
    few = F.broadcast(least.where(hot).select("u", "m"))
    return pairs.join(few, "u").unionByName(pairs.join(few, "u", "left_anti").join(least.where(~hot).select("u", "m"), "u"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node reached.

    Large-star and small-star steps alternate until the edges no longer change. Each step replaces
    edges by edges to a neighbourhood's minimum, which partial aggregation finds, so no task ever holds a whole
    component, and each pair of steps is written to scratch. No edges give no rows; loops and repeated edges count for nothing.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before, n = None, edges.count()
    for _ in range(rounds):
        large = _with_least(both(edges), 2 * n).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: each node's smaller neighbours, and itself, go to the smallest of them
        small = _with_least(large.select(F.col("b").alias("u"), F.col("a").alias("v")), 2 * n)
        small = small.select(F.col("m").alias("a"), F.col("v").alias("b")).union(small.select(F.col("m").alias("a"), F.col("u").alias("b")))
        edges = saved(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before, n = now, now.n
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
