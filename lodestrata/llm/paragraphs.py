"""Passages that repeat across documents, by MinHash banding of paragraphs.

Two kinds of paragraphs are looked at. Lines of at least LEAST words bear MinHash bands of their
five-word shingles; the bands are tuned to a recall at the similarity asked for, and lines that collide
are verified by exact Jaccard similarity and clustered by components: first each with the first of its
bucket, then, in buckets that this leaves in several clusters, all but the largest cluster's with all, in blocks. And,
as a passage may stand in the middle of a line, each text is also cut at anchors that its own words set: of
any SPREAD neighbouring word pairs the first of the least hash is an anchor, and the WORDS words from each
anchor on are a paragraph, whose one band is the hash of its words. Any passage of WORDS + SPREAD - 1 words
or more that two documents share holds such a paragraph whole, wherever it stands. Up to SPREAD - 1 words at
each end of such a passage, where it ends inside a line, are not part of the spans. Lines of fewer words than LEAST say
too little to be passages, and common ones stand in most documents.

Of each cluster the first occurrence, by doc_id and place, stays; the others are removals. A document's
paragraphs are merged to spans of words. Paragraphs of one document alone are no repeats.

A null or blank text has no paragraphs. Rows of one doc_id are one document. Null ids are left out, as no span
can be told of them. Of equal paragraphs that of the least doc_id and place is the first. Other columns, whatever their
names, are ignored, an empty table gives an empty one. A long text is hashed in parts, its words' hashes are held
together, so memory is bounded by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import BUCKETS, components, saved
from lodestrata.llm.shingles import _STEP, SLICE, WIDTH, _cuts, _words, encoded, mixed
from lodestrata.runtime import lean, ship

#: Words of the shortest line that is a paragraph; of a paragraph inside a line; neighbouring word pairs of which one is an anchor.
LEAST, WORDS, SPREAD = 16, 32, 19
PERCENT, RECALL = 80, 0.99
#: Lines of a bucket compared with as many others at once; numbers of shingles looked at together.
BLOCK, COLUMNS = 128, 1 << 13
_U = np.uint64


def tuned(similarity: float = PERCENT / 100, recall: float = RECALL, most: int = 32) -> tuple[int, int]:
    """(bands, rows) of the most selective banding that finds pairs of the similarity with the recall, among those of at most so many hashes."""
    good = [(r, b) for r in range(1, most + 1) for b in range(1, most // r + 1) if 1 - (1 - similarity**r) ** b >= recall]
    r = max(r for r, _ in good)
    return min(b for x, b in good if x == r), r


BANDS, ROWS = tuned()
#: Odd multipliers, each a bijection of 64-bit numbers.
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def texts_words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, line) of each word, for each text."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > SLICE:
            parts, n = [], 0
            for p in _cuts(texts[i]):
                start, h = _words(p)
                ends = np.flatnonzero(np.frombuffer(p, np.uint8) == 10)
                parts.append((h, np.searchsorted(ends, start) + n))
                n += len(ends)
            yield np.concatenate([h for h, _ in parts]), np.concatenate([x for _, x in parts])
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= SLICE:
            size += len(texts[j]) + 1
            j += 1
        buf = b"\n".join(texts[i:j])
        start, h = _words(buf)
        line = np.searchsorted(np.flatnonzero(np.frombuffer(buf, np.uint8) == 10), start)
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts[i:j]]))
        at = 0
        for e in ends:
            yield h[at:e], line[at:e]
            at = e
        i = j


def _least_at(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each `width` neighbouring numbers, the first of equal ones, by doubling."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(x[b] < x[a], b, a)
        have += step
    return at


def windows(h: np.ndarray, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the paragraphs at the anchors of texts that stand one behind the other; own: which text each word is of."""
    n = len(h)
    if n < WORDS:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    own = np.zeros(n, np.int32) if own is None else own
    pair = mixed(h[:-1] * _U(_STEP) + h[1:])
    low = _least_at(pair, SPREAD)
    # neighbouring stretches mostly share their least pair; where it recurs, each stretch has the first in it
    at = np.unique(low[own[: len(low)] == own[SPREAD : SPREAD + len(low)]])
    at = at[at + WORDS <= n]
    at = at[own[at] == own[at + WORDS - 1]]
    out = np.zeros(len(at), _U)
    for k in range(WORDS):
        out = out * _U(_STEP) + h[at + k]
    return at, mixed(out ^ _U(0xA5A5A5A5A5A5A5A5))


def lines_of(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, where its shingles begin) of the lines of at least LEAST words, and the shingles of all of them one behind the other."""
    cut = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
    size = np.diff(cut)
    start, size = cut[:-1][size >= LEAST], size[size >= LEAST]
    each = size - WIDTH + 1
    begin = np.cumsum(each) - each
    at = np.repeat(start - begin, each) + np.arange(each.sum())
    s = h[at]
    for k in range(1, WIDTH):
        s = s * _U(_STEP) + h[at + k]
    return start, size, begin, mixed(s)


def line_sets(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, distinct shingles) of the lines of at least LEAST words, and the sorted distinct shingles of all of them one behind the other."""
    start, size, _, s = lines_of(h, line)
    own = np.repeat(np.arange(len(start)), size - WIDTH + 1)
    order = np.lexsort((s, own))
    own, s = own[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (own[1:] != own[:-1])
    return start, size, np.bincount(own[new], minlength=len(start)), s[new]


def line_bands(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, bands) of the lines of at least LEAST words: the least of the shingles under each of a set of multipliers, joined by rows."""
    start, size, begin, s = lines_of(h, line)
    out = np.tile(np.arange(1, BANDS + 1, dtype=_U) * _U(0xD1342543DE82EF95), (len(start), 1))
    if len(start):
        for j, m in enumerate(_SEEDS):
            out[:, j // ROWS] = mixed(out[:, j // ROWS] + np.minimum.reduceat(s * m, begin))
    return start, size, out


def _together(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id of each text, first word of each, word hashes, text of each word, line of each word) of a few texts at once; lines are told apart by text and place."""
    at, ids = 0, b.column("doc_id").to_numpy()
    for texts in encoded(b.column("text")):
        found = list(texts_words(texts))
        size = np.array([len(h) for h, _ in found])
        own = np.repeat(np.arange(len(found), dtype=np.int32), size)
        line = np.concatenate([x for _, x in found]).astype(np.int64) + (own.astype(np.int64) << 40)
        yield ids[at : at + len(texts)].astype(np.int64), np.cumsum(size) - size, np.concatenate([h for h, _ in found]), own, line
        at += len(texts)


@lean
def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "doc_id", "start", "n", "whole"]
    for b in batches:
        for ids, before, h, own, line in _together(b):
            w, key = windows(h, own)
            first, n, band = line_bands(h, line)
            word = np.concatenate((w, np.repeat(first, BANDS)))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((key, band.ravel())).view(np.int64)), pa.array(ids[own[word]]), pa.array((word - before[own[word]]).astype(np.int32)),
                pa.array(np.concatenate((np.full(len(w), WORDS), np.repeat(n, BANDS))).astype(np.int32)), pa.array(np.arange(len(word)) < len(w)),
            ], names)


@lean
def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, before, h, own, line in _together(b):
            first, n, each, s = line_sets(h, line)
            ends = np.concatenate(([0], np.cumsum(each) * 8)).astype(np.int32)
            sets = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(s)])
            yield pa.RecordBatch.from_arrays([pa.array(ids[own[first]]), pa.array((first - before[own[first]]).astype(np.int32)), pa.array(n.astype(np.int32)), sets], ["doc_id", "start", "n", "shingles"])


@lean
def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = []
        for x, y in zip(b.column("s").to_pylist(), b.column("first_s").to_pylist(), strict=True):
            p, q = np.frombuffer(x, _U), np.frombuffer(y, _U)
            common = len(np.intersect1d(p, q, assume_unique=True))
            good.append(100 * common >= PERCENT * (len(p) + len(q) - common))
        yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of sets share."""
    out = np.zeros((len(sets), len(sets)))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = times > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), COLUMNS):
        a, z = np.searchsorted(column, (at, at + COLUMNS))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[a:z], column[a:z] - at] = 1
        out += m @ m.T
    return out


def _joined(held: list[tuple]) -> list[tuple[int, int]]:
    """Pairs that are near among lines (set's hash, least and greatest root, whether it asks, shingles), one of them asking; of those that connect the same, one."""
    asks = {x[0] for x in held if x[3]}
    held = list({x[0]: x for x in held}.values())
    if len(held) < 2 or min(x[1] for x in held) == max(x[2] for x in held):
        return []
    sets = [np.frombuffer(x[4], _U) for x in held]
    size, ask = np.array([len(x) for x in sets]), np.array([x[0] in asks for x in held])
    common = _common(sets)
    good = (100 * common >= PERCENT * (size[:, None] + size - common)) & (ask[:, None] | ask)
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x]
        return x

    for c, lo, *_ in held:
        up[top(c)] = top(lo)
    out = []
    for i, j in np.argwhere(np.triu(good, 1)).tolist():
        a, b = top(held[i][0]), top(held[j][0])
        if a != b:
            up[a] = b
            out.append((held[i][0], held[j][0]))
    return out


@lean
def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, b) of a block of a bucket's lines that ask and a block of all its lines, whose rows come one behind the other."""
    at, held = None, []

    def out() -> pa.RecordBatch:
        pairs = np.array(_joined(held) if len(held) > 1 else [], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for b in batches:
        for key, i, j, *row in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "c", "lo", "hi", "ask", "shingles")), strict=True):
            if (key, i, j) != at:
                yield out()
                at, held = (key, i, j), []
            held.append(tuple(row))
    yield out()


def _rest(members: DataFrame, sets: DataFrame, near: DataFrame) -> DataFrame | None:
    """Edges (a, b) between the roots of near and the hashes of sets, for pairs of a bucket that near leaves apart; members: (key, unit, leads).

    The lines of a bucket's largest cluster are connected already: the others ask, and are compared with all, block by block.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = F.xxhash64("shingles").alias("c")
    of = sets.select("unit", c).join(near.withColumnRenamed("node", "unit").hint("merge"), "unit", "left").select("unit", "c", F.coalesce("root", "unit").alias("root"))
    # all have been compared with the first of their bucket; lines of equal sets are compared once
    mine = saved(members.where("not leads").select("key", "unit").join(of.hint("merge"), "unit").select("key", "c", "root").distinct(), "members")
    apart = mine.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("n", "root"))["root"].alias("main")).where("roots > 1").select("key", "main")
    apart = saved(apart, "apart")
    if apart.isEmpty():
        return None
    mine = mine.join(apart.hint("merge"), "key")
    alike = mine.select(F.col("root").alias("a"), F.col("c").alias("b")).distinct()
    each = mine.groupBy("key", "c").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.first("main").alias("main"))
    each = saved(each.withColumn("asks", (F.col("lo") != F.col("main")) & (F.col("hi") != F.col("main"))).drop("main"), "each")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    per = each.groupBy("key").agg(blocks(F.count("*")).alias("blocks"), blocks(F.count_if("asks")).alias("q_blocks")).where("q_blocks > 0")
    each = each.join(per.hint("merge"), "key")
    place = lambda seed, n: F.pmod(F.xxhash64("c", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ["key", "i", "j", "c", "lo", "hi", "ask"]
    q = each.where("asks").withColumn("ask", F.lit(True)).withColumn("i", place(7, "q_blocks")).withColumn("j", upto("blocks")).select(cols)
    r = each.withColumn("ask", F.lit(False)).withColumn("j", place(5, "blocks")).withColumn("i", upto("q_blocks")).select(cols)
    todo = q.unionByName(r)
    asked = each.select("c").distinct()
    held = sets.select(c, "shingles").join(asked.hint("merge"), "c", "left_semi").dropDuplicates(["c"])
    dealt = todo.join(held.hint("merge"), "c").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return alike.union(dealt.select(*cols, "shingles").mapInArrow(_crossed, "a long, b long"))


@lean
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs of a document in order of their places, merged to spans."""
    names = ["doc_id", "n_spans", "n_repeated", "n_removed", "spans", "removed"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    at, every, gone, rows = None, [], [], []

    def out() -> None:
        words = lambda spans: sum(z - a for a, z in spans)
        text = lambda spans: ",".join(f"{a}:{z}" for a, z in spans)
        rows.append((at, len(every), words(every), words(gone), text(every), text(gone)))

    def add(spans: list, a: int, z: int) -> None:
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(z, spans[-1][1])
        else:
            spans.append([a, z])

    def batch() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], names)
        rows.clear()
        return b

    for b in batches:
        for doc_id, a, n, removed in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "n", "removed")), strict=True):
            if doc_id != at:
                if at is not None:
                    out()
                at, every, gone = doc_id, [], []
            add(every, a, a + n)
            if removed:
                add(gone, a, a + n)
        yield batch()
    if at is not None:
        out()
    yield batch()


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_spans, n_repeated and n_removed (words), spans and removed ("first word:end", merged) of each document with a repeated passage."""
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    schema = "key long, doc_id long, start int, n int, whole boolean"
    keys = d.mapInArrow(_keys, schema)
    # counted before they are joined; most keys stand alone and go no further
    twice = keys.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "start", "n")).alias("first")).where("lo <> hi").select("key", "first")
    found = saved(keys.join(saved(twice, "repeated").hint("merge"), "key").select("key", "doc_id", "start", "n", "whole", "first"), "found")
    same = found.where("whole").select("doc_id", "start", "n", (F.struct("doc_id", "start", "n") != F.col("first")).alias("removed"))
    unit = lambda p: F.xxhash64(*[F.col(f"{p}{c}") for c in ("doc_id", "start", "n")])
    lines = found.where("not whole").select("doc_id", "start", "n", unit("").alias("a"), unit("first.").alias("b"), "first").distinct()
    lines = saved(lines, "pairs")
    ids = lines.select("doc_id").union(lines.select("first.doc_id")).select(F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")).distinct()
    texts = d.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))).join(F.broadcast(ids), "bucket", "left_semi").select("doc_id", "text")
    sets = texts.mapInArrow(_line_sets, "doc_id long, start int, n int, shingles binary").withColumn("unit", unit(""))
    needed = lines.select(F.col("a").alias("unit")).union(lines.select(F.col("b").alias("unit"))).distinct()
    sets = saved(sets.join(needed.hint("merge"), "unit", "left_semi").select("unit", "shingles").dropDuplicates(["unit"]), "sets")
    pairs = lines.where("a <> b").select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("unit").alias("a"), F.col("shingles").alias("s")).hint("merge"), "a").join(sets.select(F.col("unit").alias("b"), F.col("shingles").alias("first_s")).hint("merge"), "b")
    near = components(pairs.select("a", "b", "s", "first_s").mapInArrow(_verified, "a long, b long"))
    near = saved(near, "near")
    members = found.where("not whole").select("key", unit("").alias("unit"), (F.struct("doc_id", "start", "n") == F.col("first")).alias("leads"))
    of = lines.select("doc_id", "start", "n", F.col("a").alias("node")).union(lines.select("first.doc_id", "first.start", "first.n", "b")).distinct()
    of = of.join(near.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = _rest(members, sets, near)
    if rest is not None:
        of = of.join(components(rest).select(F.col("node").alias("root"), F.col("root").alias("up")).hint("merge"), "root", "left").withColumn("root", F.coalesce("up", "root")).drop("up")
    of = saved(of, "lines")
    head = of.groupBy("root").agg(F.min(F.struct("doc_id", "start", "n")).alias("first"), F.max("doc_id").alias("hi")).where("first.doc_id <> hi").select("root", "first")
    similar = of.join(head.hint("merge"), "root").select("doc_id", "start", "n", (F.struct("doc_id", "start", "n") != F.col("first")).alias("removed"))
    every = same.unionByName(similar)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return every.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "start", "n").mapInArrow(_merged, "doc_id long, n_spans long, n_repeated long, n_removed long, spans string, removed string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of each document with its removals cut out; texts without any stay as they are, and are not shuffled."""
    gone = saved(repeats(docs).where("n_removed > 0").select("doc_id", "removed"), "removals")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("_bucket")
    asked = F.broadcast(gone.select(place).distinct())
    d = docs.select("doc_id", "text").withColumn("_bucket", place)
    hit = d.join(asked, "_bucket", "left_semi").join(gone, "doc_id", "left").select("doc_id", "text", "removed").mapInArrow(_cut_out, "doc_id long, text string")
    # a null id is in no bucket
    return d.join(asked, "_bucket", "left_anti").select("doc_id", "text").unionByName(hit)


@lean
def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import re

    word = re.compile("[^ \t-\r]+")
    for b in batches:
        texts = []
        for text, removed in zip(b.column("text").to_pylist(), b.column("removed").to_pylist(), strict=True):
            if removed:
                ends = [(m.start(), m.end()) for m in word.finditer(text)]
                at, parts = 0, []
                for a, z in (map(int, x.split(":")) for x in removed.split(",")):
                    parts.append(text[at : ends[a][0]])
                    at = ends[z - 1][1]
                text = "".join([*parts, text[at:]])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
