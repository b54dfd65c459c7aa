"""Mixing sources to target weights by drawn blocks.

The words of a source stand in one stream, document behind document, cut into blocks of a fixed length.
The output is cut into shards of equal size. Of each shard's slots a source gets the whole part of its
share for certain; the slots that are left go to the sources by a multinomial draw over the fractions,
seeded by the shard, so that any shard is drawn alone and the same way on every rerun. What a source gets
is the sum of what the shards drew. (A draw of all slots would miss the target of a source of 300 blocks by 6 %
on average; this one misses it by a block or two in one shard, and by about the root of a quarter of the shards in
many.) The j-th slot of a source holds the block that a keyed permutation of the source's block numbers has in
place j modulo their number: every block comes once before any comes again, and without a table of the order;
slots beyond REPEATS of every block stay empty. Blocks are joined by (source, block number).

Null texts have no words. Null sources are one source, ordered last. Rows of one doc_id are told apart
by their place in the stream. A source without words has a target of 0. An empty table gives an empty one.
mixture() keeps all columns, whatever their names; of rows equal in doc_id, source and size the texts may change
places. Memory is bounded by the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.common import fresh, n_words_of, saved
from lodestrata.runtime import lean, ship

#: Weights of the sources in code point order, repeating; the mix's size as a share of all words; the most that a source may be repeated.
WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Words in a block. A source's words come within about a block of its target.
BLOCK = 64
#: Slots in an output shard; sources that are drawn together; shards that one running sum covers.
SHARD_SLOTS, GROUP_SOURCES, CHUNK_SHARDS = 1 << 14, 4096, 4096


def _mixed(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def permuted(at: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of range(n) sends each number: four Feistel rounds over the next power of 4, walked on until inside."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(_mixed(key + r * 0x9E3779B97F4A7C15)) for r in range(4)]
    out = at.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            f = (right + k) * np.uint64(0xFF51AFD7ED558CCD)
            f = (f ^ (f >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((f >> np.uint64(29)) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shard_counts(shard: int, rest: float, groups: list[float], group: int, fractions: list[float], seed: int) -> np.ndarray:
    """How many of a shard's drawn slots each source of a group gets: a multinomial draw of groups, and in the group one of its sources.

    rest: slots of a shard that are drawn, on average; groups: each group's share of them. Every task that
    draws for a shard finds the same counts of its groups.
    """
    n = int(np.floor((shard + 1) * rest + 1e-9) - np.floor(shard * rest + 1e-9))
    key = seed & (1 << 63) - 1
    p = np.array(groups)
    mine = int(np.random.default_rng([key, shard]).multinomial(n, p / p.sum())[group]) if n and p.sum() > 0 else 0
    f = np.array(fractions)
    if not mine or f.sum() <= 0:
        return np.zeros(len(f), np.int64)
    return np.random.default_rng([key, shard, group + 1]).multinomial(mine, f / f.sum())


@lean
def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_id, shard, n) of each shard and group of sources."""
    for b in batches:
        for shard, group, ids, share, groups, seed in zip(*(b.column(c).to_pylist() for c in ("shard", "group", "ids", "share", "groups", "seed")), strict=True):
            whole = np.floor(share)
            n = whole.astype(np.int64) + shard_counts(shard, sum(groups), groups, group, np.array(share) - whole, seed)
            got = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[got]), pa.array(np.full(len(got), shard)), pa.array(n[got])], ["source_id", "shard", "n"])


@lean
def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block of each slot of a source in a shard."""
    names = ["shard", "source_id", "slot", "block"]
    for b in batches:
        for sid, shard, blocks, start, n, seed in zip(*(b.column(c).to_pylist() for c in ("source_id", "shard", "blocks", "start", "n", "seed")), strict=True):
            n = min(n, REPEATS * blocks - start)  # nothing is repeated more often
            if n <= 0:
                continue
            slot = start + np.arange(n)
            epoch, at = slot // blocks, slot % blocks
            block = np.empty(n, np.int64)
            for e in range(int(epoch[0]), int(epoch[-1]) + 1):
                own = epoch == e
                block[own] = permuted(at[own], blocks, _mixed(_mixed(seed * 1_000_003 + sid) + e + 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard), pa.int64()), pa.array(np.full(n, sid), pa.int64()), pa.array(slot, pa.int64()), pa.array(block, pa.int64())], names)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_id, source_size, target): shares by weight, filled up to REPEATS times a source's size.

    sizes: source, size. The excess of sources at their limit goes to the others by weight, which ends
    where every source has the lesser of its limit and one level times its weight; the level is found by
    running sums over the sources in the order in which they reach their limits.
    """
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    s = s.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("long") - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("source_id") % len(WEIGHTS) + 1).cast("int")))
    s = s.withColumn("most", REPEATS * F.col("source_size")).withColumn("reach", F.col("most") / F.col("weight"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("reach", "source_id").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    left = SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(order), F.lit(0))
    s = s.withColumn("level", left / rest)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("reach"), F.struct("reach", "source_id", "level"))).over(every)["level"])
    return s.select("source", "source_id", "source_size", F.coalesce(F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


class Mix:
    """A mix of documents: `sources`, `placed` (each row's place in its source's stream) and `slots` (shard, source_id, slot, block)."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, seed: int = 11, shard_slots: int = SHARD_SLOTS):
        ship(docs.sparkSession)
        self.block = block
        rows = saved(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), n_words_of(F.col("text").cast("string")).alias("size")), "sizes")
        n = rows.count()
        self.sources = saved(targets(rows), "sources")
        chunks = max(8, math.isqrt(n))  # chunks of a source, and rows of one in a chunk, both grow with the root
        # rows of one id and size are one until they have their places
        r = rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
        r = r.join(self.sources, r["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        r = r.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks))).withColumn("words", F.col("size") * F.col("copies"))
        inside = Window.partitionBy("source_id", "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        per = r.groupBy("source_id", "chunk").agg(F.sum("words").alias("n"))
        before = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("source_id", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
        r = r.withColumn("start", F.sum("words").over(inside) - F.col("words")).join(per, ["source_id", "chunk"])
        r = r.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        self.placed = saved(r.select("doc_id", "source", "size", "source_id", "source_size", "target", (F.col("start") + F.col("offset") + F.col("copy") * F.col("size")).cast("long").alias("start")), "placed")
        q = self.sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        q = q.withColumn("slots", F.least(F.col("target") * F.col("blocks") / F.col("source_size"), (REPEATS * F.col("blocks")).cast("double")))
        shards = max(1, -(-int(q.agg(F.sum("slots")).first()[0] or 0) // shard_slots))
        # each shard gets the whole part of a source's share for certain and draws the rest
        q = saved(q.select("source_id", "blocks", (F.col("slots") / shards).alias("share"), F.floor(F.col("source_id") / GROUP_SOURCES).cast("int").alias("group")), "shares")
        g = q.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("source_id", "share"))).alias("s"), F.sum(F.col("share") - F.floor("share")).alias("f"))
        g = g.select("group", F.col("s.source_id").alias("ids"), F.col("s.share").alias("share"), "f")
        fractions = [r.f for r in g.select("group", "f").orderBy("group").collect()]  # a number for every GROUP_SOURCES sources
        g = g.withColumns({"groups": F.array(*[F.lit(float(f)) for f in fractions]).cast("array<double>"), "seed": F.lit(seed).cast("long")})
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        g = g.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long")))).repartition(parts, "shard", "group")
        #: What each shard draws: (source_id, shard, n).
        self.draws = saved(g.mapInArrow(_draw, "source_id long, shard long, n long"), "draws")
        # a slot's number in its source: running sums over the shards, in two levels
        d = self.draws.withColumn("chunk", F.floor(F.col("shard") / CHUNK_SHARDS))
        inside = Window.partitionBy("source_id", "chunk").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        upto = Window.partitionBy("source_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        per = d.groupBy("source_id", "chunk").agg(F.sum("n").alias("of")).select("source_id", "chunk", F.coalesce(F.sum("of").over(upto), F.lit(0)).alias("upto"))
        d = d.withColumn("start", F.sum("n").over(inside) - F.col("n")).join(per, ["source_id", "chunk"]).join(q.select("source_id", "blocks"), "source_id")
        d = d.select("source_id", "shard", "blocks", (F.col("start") + F.col("upto")).cast("long").alias("start"), "n", F.lit(seed).cast("long").alias("seed"))
        # as many tasks as a shuffle has: the rows are few, but not what each makes
        self.slots = d.repartition(parts, "source_id", "shard").mapInArrow(_slots, "shard long, source_id long, slot long, block long")

    def segments(self) -> DataFrame:
        """The parts of documents in each block, with how often the mix takes them: the join by block number."""
        # the planner takes the slots for as few as the rows they are made from, and would broadcast them
        times = self.slots.groupBy("source_id", "block").agg(F.count("*").alias("times")).hint("merge")
        p = self.placed.where("size > 0")
        b = F.lit(self.block)
        p = p.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        p = p.select("doc_id", "source", "size", "source_id", "start", "block", F.greatest(F.col("block") * b - F.col("start"), F.lit(0)).alias("from"), F.least((F.col("block") + 1) * b - F.col("start"), F.col("size")).alias("to"))
        return p.join(times, ["source_id", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))


def op9(docs: DataFrame) -> DataFrame:
    mix = Mix(docs)
    taken = mix.segments().groupBy("source_id", "start").agg(F.sum((F.col("to") - F.col("from")) * F.col("times")).cast("long").alias("taken"))
    full = mix.placed.where("size > 0").join(taken, ["source_id", "start"])
    none = mix.placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    return full.select(cols).unionByName(none.select(cols))


@lean
def _assemble(batches: Iterator[pa.RecordBatch], names: list[str], schema: pa.Schema, size: str, part: str) -> Iterator[pa.RecordBatch]:
    """Rows of a doc_id: first the parts to take of each copy of it in the table, then the copies."""
    import re

    word = re.compile("[^ \t-\r]+")
    waiting: dict[tuple, list] = {}
    at = None
    for b in batches:
        out: list[dict] = []
        for row in b.to_pylist():
            key = (row["doc_id"], row["source"], row[size])
            if at != key:
                waiting, at = {}, key
            if row[part] is not None:
                waiting.setdefault(key, []).append(row[part])
                continue
            parts = sorted((p["from"], p["to"], p["times"]) for p in (waiting.get(key) or [[]]).pop())
            for copy in range(1, REPEATS + 1):
                runs: list[list[int]] = []
                for lo, hi, times in parts:
                    if times >= copy:
                        if runs and runs[-1][1] == lo:
                            runs[-1][1] = hi
                        else:
                            runs.append([lo, hi])
                if not runs:
                    continue
                text = row["text"]
                if runs != [[0, row[size]]]:
                    ends = [(m.start(), m.end()) for m in word.finditer(text)]
                    text = "\n".join(text[ends[lo][0] : ends[hi - 1][1]] for lo, hi in runs)
                new = {n: row[n] for n in names} | {"text": text}
                if "n_chars" in new:
                    new["n_chars"] = len(text)
                out.append(new)
        yield pa.RecordBatch.from_pylist(out, schema)


def mixture(docs: DataFrame) -> DataFrame:
    """docs with each row's text cut to the parts that the mix takes; parts taken twice make a second row. Rows of which nothing is taken go.

    Texts travel once, to the task of their doc_id, where they meet their parts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    mix = Mix(docs)
    size, part, turn = fresh(docs, "_size", "_parts", "_turn")
    parts = mix.segments().where("times > 0").groupBy("doc_id", "source", "size", "source_id", "start").agg(F.collect_list(F.struct("from", "to", "times")).alias("held"))
    names = docs.columns
    kind = "array<struct<from:bigint,to:bigint,times:bigint>>"
    left = parts.select("doc_id", "source", F.col("size").alias(size), F.col("held").cast(kind).alias(part), F.lit(0).alias(turn))
    right = docs.withColumns({size: n_words_of(F.col("text")), part: F.lit(None).cast(kind), turn: F.lit(1)})
    both = left.unionByName(right, allowMissingColumns=True).repartition("doc_id", "source", size).sortWithinPartitions("doc_id", "source", size, turn)
    schema = docs.schema
    arrow = to_arrow_schema(schema)
    return both.mapInArrow(lambda it: _assemble(it, names, arrow, size, part), schema)
