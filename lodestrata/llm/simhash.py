"""SimHash near-duplicates: fingerprints within a few bits, by tiled exact comparison.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles. Equal fingerprints
are one node. Two that differ in RADIUS bits or fewer agree in one of RADIUS + 1 stripes of their bits, so each
stripe deals the nodes into groups by the top bits of that stripe, as many groups as keep them near GROUP nodes.
A group is cut into tiles by population count, and a tile of over TILE nodes into several. Population counts of
linked fingerprints differ by RADIUS at most: a tile is sent only to the tiles of its group that are so near, and
there the two are compared whole, by exclusive-or and bit counts in numpy. What travels is some eight bytes for
each stripe and near population count, whatever the texts' length; comparisons grow with nodes times GROUP.
A task hands on a forest of its links, so a large group of near fingerprints gives no more edges than nodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import components, saved
from lodestrata.llm.shingles import encoded
from lodestrata.runtime import lean, ship

#: Words in a shingle, the seed of its hash, and in how many bits linked fingerprints may differ.
WIDTH, SEED, RADIUS = 3, 42, 3
#: Nodes that a group aims at, nodes of a tile at most, tiles of a population count that one task compares a tile with, and rows of a tile compared at once.
GROUP, TILE, SIDE, STEP = 1 << 14, 4096, 16, 512
#: Hashes counted at once, and links that a task holds before it makes a forest of them.
SLICE, LINKS = 1 << 16, 1 << 20
#: A fingerprint of more than one row in so many is sent to every task when component ids are handed back: HOT of them at most.
HOT = 4096
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text in UTF-8; 0 if it has no words, the hash of all its words if it has fewer than WIDTH."""
    words = _WORD.findall(text.lower())  # of bytes, lower() changes A-Z alone
    if not words:
        return 0
    if len(words) < WIDTH:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    m = len(words) - WIDTH + 1
    set_in = np.zeros(64, np.int64)
    for at in range(0, m, SLICE):
        part = words[at : min(at + SLICE, m) + WIDTH - 1]
        joined = memoryview(b" ".join(part))
        ends = np.cumsum([len(w) + 1 for w in part]) - 1
        starts = np.concatenate(([0], ends[: -WIDTH] + 1))
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:z], SEED) for a, z in zip(starts.tolist(), ends[WIDTH - 1 :].tolist(), strict=True)], np.uint64)
        set_in += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > m).tobytes(), "big")


@lean
def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for texts in encoded(b.column("text")) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "print"])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links (a, b) between their places: the least place that each reaches."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up


def near_links(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of fingerprints of left and right within RADIUS bits, compared STEP by all of right."""
    for at in range(0, len(left), STEP):
        i, j = np.nonzero(np.bitwise_count(left[at : at + STEP, None] ^ right[None, :]) <= RADIUS)
        if len(i):
            yield i + at, j


def _compared(table: pa.Table) -> pa.Table:
    """Links of one tile to itself and to the tiles sent to it, as edges to the least place of each local component."""
    print_, own = table.column("print").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
    left, right = print_[own], print_[~own]
    every = np.concatenate((left, right)).view(np.uint64)
    root, a, b, held = np.arange(len(every)), [], [], 0
    for start in range(0, len(every), TILE):
        for i, j in near_links(every[: len(left)], every[start : start + TILE]):
            a.append(i)
            b.append(j + start)
            held += len(i)
            if held >= LINKS:
                root = forest(np.concatenate((np.arange(len(every)), *a)), np.concatenate((root, *b)), len(every))
                a, b, held = [], [], 0
    if a:
        root = forest(np.concatenate((np.arange(len(every)), *a)), np.concatenate((root, *b)), len(every))
    linked = np.flatnonzero(root != np.arange(len(every)))
    signed = every.view(np.int64)
    return pa.Table.from_arrays([pa.array(signed[root[linked]]), pa.array(signed[linked])], ["a", "b"])


def links(nodes: DataFrame, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect what is linked among distinct fingerprints (print, a long)."""
    n = nodes.count()
    stripes, width = RADIUS + 1, 64 // (RADIUS + 1)
    top = min(width, max(0, (-(-n // group) - 1).bit_length()))  # bits of a stripe that name the group
    stripe = F.explode(F.array(*[F.struct(F.lit(s).alias("stripe"), F.shiftrightunsigned("print", 64 - s * width - top).bitwiseAND((1 << top) - 1).alias("range")) for s in range(stripes)]) if top else F.array(F.struct(F.lit(0).alias("stripe"), F.lit(0).cast("long").alias("range"))))
    dealt = nodes.select("print", F.bit_count("print").alias("pop"), stripe.alias("g")).select("print", "pop", "g.stripe", "g.range")
    tiles = dealt.groupBy("stripe", "range", "pop").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts"))
    tiles = saved(tiles, "tiles")
    # what a tile needs to know of its group: into how many tiles the near population counts are cut
    near = tiles.select("stripe", "range", F.explode(F.sequence(F.col("pop") - RADIUS, F.col("pop") + RADIUS)).alias("pop"), F.struct(F.col("pop").alias("to"), "cuts").alias("near"))
    near = near.groupBy("stripe", "range", "pop").agg(F.collect_list("near").alias("near"))  # 2 * RADIUS + 1 at most
    sent = dealt.join(near, ["stripe", "range", "pop"])
    own_cuts = F.filter("near", lambda x: x["to"] == F.col("pop"))[0]["cuts"]
    most = F.array_max(F.transform(F.filter("near", lambda x: x["to"] >= F.col("pop")), lambda x: x["cuts"]))
    sent = sent.withColumn("cut", F.pmod(F.xxhash64("print"), own_cuts).cast("int")).withColumn("sides", F.ceil(most / SIDE).cast("int"))
    cols = ["print", "stripe", "range"]
    own = sent.select(*cols, F.lit(True).alias("own"), F.col("pop").alias("to"), F.col("cut").alias("to_cut"), F.explode(F.sequence(F.lit(0), F.col("sides") - 1)).alias("side"))
    others = sent.withColumn("near", F.explode(F.filter("near", lambda x: x["to"] <= F.col("pop"))))
    others = others.select(*cols, F.lit(False).alias("own"), F.col("near.to").alias("to"), F.explode(F.sequence(F.lit(0), F.col("near.cuts") - 1)).alias("to_cut"), F.floor(F.col("cut") / SIDE).cast("int").alias("side"), "pop", "cut")
    others = others.where("to < pop or to_cut < cut").drop("pop", "cut")
    return own.unionByName(others).groupBy("stripe", "range", "to", "to_cut", "side").applyInArrow(_compared, "a long, b long")


def near_copies(docs: DataFrame, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id, the smallest doc_id that links reach, of each row.

    A null text is empty; texts without words have fingerprint zero and are linked like any other. Rows of one
    doc_id are judged each by its own text. Null ids stay null and count in no minimum. Other columns are ignored.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = saved(d.mapInArrow(_fingerprints, "doc_id long, print long"), "prints")
    own = saved(rows.groupBy("print").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies")), "classes")
    roots = components(links(own.select("print"), group, tile))
    least = roots.join(own.select(F.col("print").alias("node"), "own"), "node").groupBy("root").agg(F.min("own").alias("least"))
    least = roots.join(least, "root").select(F.col("node").alias("print"), "least")
    ids = saved(own.join(least, "print", "left").select("print", "copies", F.coalesce("least", "own").alias("component_id")), "components")
    hot = F.broadcast(ids.where(F.col("copies") * HOT >= max(1, rows.count())).select("print", "component_id"))
    cols = ["doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"]
    often = rows.join(hot, "print").select(cols)
    return often.unionByName(rows.join(hot, "print", "left_anti").join(ids.select("print", "component_id"), "print").select(cols))
