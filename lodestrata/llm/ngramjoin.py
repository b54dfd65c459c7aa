"""Exact Jaccard self-join of documents on word shingles, by prefix filters under several token orders.

Texts of one shingle set are a class, and classes are joined. The steps, none of which holds all
documents of a key, makes all pairs of a group, or drops a link:

1. Count filter. A class with a partner shares at least four fifths of its shingles, so of a random half
   of its shingles (those with a small hash) it misses at most a fifth of the whole. Which of them are
   held by two classes is found in one shuffle of short hashes; a chunk of documents sends a shingle that
   it holds twice only once, so a shingle of every document costs a line per chunk. The classes with
   enough shared shingles survive.
2. Orders. Over the survivors alone, shingles are ordered by document frequency, ties by hash (order A)
   or by another hash (order B). Of a pair that links, both have a common shingle in the first fifth of
   their shingles under A, and one under B.
3. Candidates. Each shingle links the classes that have it in their prefix under A to the one of them with
   the most frequent shingles. Components of these edges hold every possible pair.
4. Verification inside a candidate component: pairs that share in A and in B, and are not connected yet,
   are counted exactly. Components of many shingles are cut into blocks: first all members meet the
   most central one, then those not linked to it, block by block, meet all.

Shingles are 64-bit hashes and classes 128-bit ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import ROW, components, saved, row_hashes, without
from lodestrata.llm.shingles import encoded, mixed, shingle_sets
from lodestrata.runtime import lean, ship

#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Documents in a chunk of the count filter, classes in a chunk of the frequencies, buckets of ids that go to every task.
CHUNK, NODES_CHUNK, BUCKETS = 4096, 1024, 1 << 20
#: Hashes in a chunk of the count filter, for the memory of its task.
CHUNK_HASHES = 600_000
#: Shingles, and classes, of a candidate component that one task verifies; larger ones are cut into blocks of as many.
BLOCK, MEMBERS = 4_000_000, 8192
#: Shingles that one task counts, and tasks at most: the parts grow with the input where the session's setting does not.
PART, MOST_PARTS = 4_000_000, 1 << 16
#: A class of more than one row in so many is sent to every task.
HOT = 4096
_U = np.uint64


def _sets(b: pa.RecordBatch) -> Iterator[np.ndarray]:
    for texts in encoded(b.column("text")):
        yield from shingle_sets(texts)


def _chosen(s: np.ndarray) -> np.ndarray:
    """The half of a set with small hashes."""
    return s[: np.searchsorted(s, _U(1 << 63))]


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True) or 1


@lean
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = [x for x in b.schema.names if x != "text"]
        keys, n, chosen = [], [], []
        for s in _sets(b):
            keys.append(_key(s))
            n.append(len(s))
            chosen.append(len(_chosen(s)))
        yield pa.RecordBatch.from_arrays([*map(b.column, kept), pa.array(n, pa.int64()), pa.array(chosen, pa.int64()), pa.array(keys, pa.binary()), pa.array([_short(k) for k in keys], pa.int64())], [*kept, "n", "chosen", "key", "short"])


@lean
def _blobs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Per chunk and part: hashes that the chunk's classes hold, and which class; a class of 0 says that two hold it already. Rows without hashes give the counts known inside the chunk."""
    names = ["part", "tokens", "owners", "classes"]
    seen: set[bytes] = set()

    def out(sets: list[np.ndarray], keys: list[bytes]) -> Iterator[pa.RecordBatch]:
        classes = np.array([0, *map(_short, keys)], np.int64)
        h = np.concatenate(sets)
        own = np.repeat(np.arange(1, len(sets) + 1, dtype=np.uint16), [len(s) for s in sets])
        code = ((h >> _U(40)) % _U(parts)) << _U(32) | (h & _U(0xFFFFFFFF))
        order = np.argsort(code, kind="stable")
        code, own = code[order], own[order]
        first = np.concatenate(([True], code[1:] != code[:-1]))
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, len(code)))
        twice = np.repeat(size > 1, size)
        counts = np.bincount(own[twice], minlength=len(classes))
        got = np.flatnonzero(counts)
        rows: list[tuple] = [(int(code[0] % _U(parts)), b"", counts[got].astype(np.int32).tobytes(), classes[got].tobytes())] if len(got) else []
        # of a hash held twice in the chunk one line goes on, for no class
        own = np.where(twice, 0, own).astype(np.uint16)[first]
        code = code[first]
        part = (code >> _U(32)).astype(np.int64)
        cut = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            a, z = cut[p], cut[p + 1]
            if z > a:
                used, local = np.unique(own[a:z], return_inverse=True)
                rows.append((p, (code[a:z] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(), local.astype(np.uint16).tobytes(), classes[used].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names)

    sets: list[np.ndarray] = []
    keys: list[bytes] = []
    held = 0
    for b in batches:
        for s in _sets(b):
            key, s = _key(s), _chosen(s)
            if not len(s) or key in seen:
                continue
            seen.add(key)
            sets.append(s)
            keys.append(key)
            held += len(s)
            if len(sets) >= CHUNK or held >= CHUNK_HASHES:
                yield from out(sets, keys)
                sets, keys, held = [], [], 0
                seen.clear()  # copies in other chunks are told apart by the part that counts
    if sets:
        yield from out(sets, keys)


@lean
def _shared(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """For each part that classes are dealt to: classes, and how many of their hashes in this part another class holds too."""
    toks, owns, classes, counts = [], [], [], []
    for b in batches:
        for t, o, c in zip(*(b.column(x).to_pylist() for x in ("tokens", "owners", "classes")), strict=True):
            named = np.frombuffer(c, np.int64)
            if t:
                toks.append(np.frombuffer(t, np.uint32))
                owns.append(named[np.frombuffer(o, np.uint16)])
            else:
                classes.append(named)
                counts.append(np.frombuffer(o, np.int32).astype(np.int64))
    if toks:
        tok, own = np.concatenate(toks), np.concatenate(owns)
        del toks, owns
        order = np.lexsort((own, tok))
        tok, own = tok[order], own[order]
        new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])))
        tok, own = tok[new], own[new]
        begin = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        size = np.diff(np.append(begin, len(tok)))
        known = np.repeat((size > 1) | np.logical_or.reduceat(own == 0, begin), size)
        got, n = np.unique(own[known & (own != 0)], return_counts=True)
        classes.append(got)
        counts.append(n.astype(np.int64))
    if classes:
        yield from _dealt(*_added(classes, counts), parts)


def _added(classes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, inv = np.unique(np.concatenate(classes), return_inverse=True)
    return every, np.bincount(inv, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)


def _dealt(classes: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A row of packed arrays for each part, not one for each class: a class has shingles in every part."""
    part = mixed(classes.view(_U)) % _U(parts)
    order = np.argsort(part, kind="stable")
    classes, counts = classes[order], counts[order]
    cut = np.searchsorted(part[order], np.arange(parts + 1).astype(_U))
    rows = [(p, classes[a:z].tobytes(), counts[a:z].tobytes()) for p, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if z > a]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["part", "classes", "counts"])


@lean
def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class the sum of its counts."""
    classes, counts = [], []
    for b in batches:
        classes += [np.frombuffer(c, np.int64) for c in b.column("classes").to_pylist()]
        counts += [np.frombuffer(c, np.int64) for c in b.column("counts").to_pylist()]
    if classes:
        c, n = _added(classes, counts)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["short", "shared"])


@lean
def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, count = TaskContext.get().partitionId(), 0
    for b in batches:
        keys, n, raw, chunk = [], [], [], []
        for s in _sets(b):
            keys.append(_key(s))
            n.append(len(s))
            raw.append(s.tobytes())
            chunk.append(task << 32 | count // NODES_CHUNK)
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], ["chunk", "key", "n", "tokens"])


@lean
def _chunk_counts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Per chunk and part: the chunk's distinct shingles and how many of its classes hold each."""
    names = ["part", "chunk", "tokens", "counts"]

    def out(chunk: int, sets: list[bytes]) -> pa.RecordBatch:
        tok, n = np.unique(np.concatenate([np.frombuffer(s, _U) for s in sets]), return_counts=True)
        part = (tok >> _U(40)) % _U(parts)
        order = np.argsort(part, kind="stable")
        tok, n, part = tok[order], n[order].astype(np.uint32), part[order]
        cut = np.searchsorted(part, np.arange(parts + 1).astype(_U))
        rows = [(p, chunk, tok[a:z].tobytes(), n[a:z].tobytes()) for p, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if z > a]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names)

    at, sets, held = None, [], 0
    for b in batches:
        for chunk, raw in zip(b.column("chunk").to_pylist(), b.column("tokens").to_pylist(), strict=True):
            if not raw:
                continue
            if sets and (chunk != at or held > 1 << 25):  # a chunk may come in several counts: they are added up
                yield out(at, sets)
                sets, held = [], 0
            at = chunk
            sets.append(raw)
            held += len(raw)
    if sets:
        yield out(at, sets)


@lean
def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk: its shingles of this part that two classes or more hold, and by how many."""
    rows = [r for b in batches for r in zip(*(b.column(x).to_pylist() for x in ("chunk", "tokens", "counts")), strict=True)]
    if not rows:
        return
    toks = [np.frombuffer(t, _U) for _, t, _ in rows]
    every, inv = np.unique(np.concatenate(toks), return_inverse=True)
    df = np.bincount(inv, weights=np.concatenate([np.frombuffer(c, np.uint32) for _, _, c in rows]))
    df = np.minimum(df, 0xFFFFFFFF).astype(np.uint32)[inv]
    at = 0
    for (chunk, _, _), t in zip(rows, toks, strict=True):
        d = df[at : at + len(t)]
        at += len(t)
        two = d > 1
        if two.any():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([t[two].tobytes()], pa.binary()), pa.array([d[two].tobytes()], pa.binary())], ["chunk", "tokens", "df"])


def prefix_length(n: int) -> int:
    """Of how many first shingles two linked sets must share one: all but those that both may lack, and one more."""
    return n - -(-PERCENT * n // 100) + 1


def _prefixes(key, nodes: pa.Table, known: pa.Table) -> pa.Table:
    """Per class: its shared shingles in the prefix under each order, and how central it is."""
    tok = np.concatenate([np.frombuffer(x, _U) for x in known.column("tokens").to_pylist()] or [np.zeros(0, _U)])
    df = np.concatenate([np.frombuffer(x, np.uint32) for x in known.column("df").to_pylist()] or [np.zeros(0, np.uint32)])
    order = np.argsort(tok, kind="stable")
    tok, df = tok[order], df[order]
    rows = []
    for node, n, raw in zip(*(nodes.column(x).to_pylist() for x in ("node", "n", "tokens")), strict=True):
        s = np.frombuffer(raw, _U)
        at = np.searchsorted(tok, s)
        at[at == len(tok)] = 0
        hit = tok[at] == s if len(tok) else np.zeros(len(s), bool)
        mine, freq = s[hit], df[at[hit]] if len(tok) else df
        take = prefix_length(n) - (n - len(mine))  # shingles of one class alone stand first and share nothing
        if take <= 0 or not len(mine):
            continue
        a = mine[np.lexsort((mine, freq))[:take]]
        b = mine[np.lexsort((mixed(mine), freq))[:take]]
        rows.append((node, n, float(freq.sum(dtype=np.float64)) / n, a.tobytes(), b.tobytes()))
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary()), strict=True)], ["node", "n", "weight", "a", "b"])


@lean
def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.frombuffer(x, np.int64) for x in b.column("a").to_pylist()]
        if sets:
            size = [len(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(np.repeat(b.column("node").to_numpy(), size)), pa.array(np.repeat(b.column("weight").to_numpy(), size))], ["token", "node", "weight"])


class _Index:
    """Which of some sets hold a token."""

    def __init__(self, sets: list[np.ndarray]):
        own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        tok = np.concatenate(sets) if sets else np.zeros(0, _U)
        order = np.argsort(tok, kind="stable")
        self.own, tok = own[order], tok[order]
        self.tok, self.begin = np.unique(tok, return_index=True)
        self.end = np.append(self.begin[1:], len(tok))
        self.n = len(sets)

    def counts(self, s: np.ndarray) -> np.ndarray:
        """How many tokens of s each set holds."""
        at = np.searchsorted(self.tok, s)
        at[at == len(self.tok)] = 0
        at = at[self.tok[at] == s] if len(self.tok) else at[:0]
        if not len(at):
            return np.zeros(self.n, np.int64)
        return np.bincount(np.concatenate([self.own[self.begin[k] : self.end[k]] for k in at]), minlength=self.n)


def _linked(common, n, m):
    return 100 * common >= PERCENT * (n + m - common)


def links(queries: list[int], ids: list[int], sets: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray], weight: list[float], label: list[int]) -> list[tuple[int, int]]:
    """Links that connect what is linked: between each query (a place in the lists) and the other places. Places of one label are connected already."""
    place: dict[int, int] = {}
    root = np.array([place.setdefault(x, i) for i, x in enumerate(label)])
    size = np.array([len(s) for s in sets])
    in_a, in_b, whole = _Index(a), _Index(b), None
    out = []
    for q in sorted(queries, key=lambda i: (-weight[i], ids[i])):
        could = (in_a.counts(a[q]) > 0) & (in_b.counts(b[q]) > 0)  # the filters of both orders
        could &= root != root[q]
        could &= (100 * np.minimum(size, size[q]) >= PERCENT * np.maximum(size, size[q]))
        todo = np.flatnonzero(could)
        if len(todo) > 16:
            whole = whole or _Index(sets)
            common = whole.counts(sets[q])[todo]
        else:
            common = np.array([len(np.intersect1d(sets[q], sets[i], assume_unique=True)) for i in todo], np.int64)
        for i in todo[_linked(common, size[q], size[todo])] if len(todo) else ():
            if root[i] != root[q]:
                out.append((ids[q], ids[i]))
                root[root == root[i]] = root[q]
    return out


def _resolve(table: pa.Table) -> pa.Table:
    """Links of one task's members; rows that are queries meet all rows."""
    rows = sorted(table.select(["node", "query", "label", "weight", "tokens", "a", "b"]).to_pylist(), key=lambda r: (r["node"], not r["query"]))
    rows = [r for i, r in enumerate(rows) if not i or r["node"] != rows[i - 1]["node"]]  # a query is a member too
    arrays = {c: [np.frombuffer(r[c], _U) for r in rows] for c in ("tokens", "a", "b")}
    found = links([i for i, r in enumerate(rows) if r["query"]], [r["node"] for r in rows], arrays["tokens"], arrays["a"], arrays["b"], [r["weight"] for r in rows], [r["label"] for r in rows])
    cols = list(zip(*found, strict=True)) if found else [(), ()]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])


@lean
def _to_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hit = []
        for x, y in zip(b.column("tokens").to_pylist(), b.column("centre_tokens").to_pylist(), strict=True):
            s, t = np.frombuffer(x, _U), np.frombuffer(y, _U)
            hit.append(bool(_linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t))))
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("centre"), pa.array(hit)], ["node", "centre", "hit"])


def _large(members: DataFrame, per: DataFrame) -> DataFrame:
    """Links of the components that no single task holds."""
    m = members.join(per.where("size > 1").select("comp", "blocks"), "comp")
    top = m.groupBy("comp").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"))
    sets = members.select(F.col("node").alias("centre"), F.col("tokens").alias("centre_tokens"))
    salts = 64
    top = top.join(sets, "centre").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = m.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(top, ["comp", "salt"]).select("node", "tokens", "centre", "centre_tokens")
    met = saved(met.mapInArrow(_to_centre, "node long, centre long, hit boolean"), "star")
    star = met.where("hit and node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    m = m.join(met.select("node", "hit", "centre"), "node").withColumn("label", F.when(F.col("hit"), F.col("centre")).otherwise(F.col("node")))
    # those that the centre did not reach meet all members, block by block
    rest = m.where("not hit").groupBy("comp").agg(F.ceil(F.greatest(F.lit(1), F.sum("n") / BLOCK, F.count("*") / MEMBERS)).cast("int").alias("q_blocks"))
    m = m.join(rest, "comp")
    place = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    q_place = F.pmod(F.xxhash64("node", F.lit(1)), F.col("q_blocks")).cast("int")
    cols = ["comp", "i", "j", "node", "query", "label", "weight", "tokens", "a", "b"]
    q = m.where("not hit").withColumn("query", F.lit(True)).withColumn("i", q_place).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    r = m.withColumn("query", F.lit(False)).withColumn("j", place).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    found = q.select(cols).unionByName(r.select(cols)).groupBy("comp", "i", "j").applyInArrow(_resolve, "a long, b long")
    return star.unionByName(found)


def join_classes(docs: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, n, key, and keep; groups: key, component): classes with a link have the smallest doc_id of their component's. keep: long columns."""
    spark = ship(docs.sparkSession)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts_for = lambda n: min(MOST_PARTS, max(least, -(-(n or 0) // PART)))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in keep], F.col("text").cast("string").alias("text"))
    rows = saved(kept.mapInArrow(_rows, "doc_id long, " + "".join(f"{c} long, " for c in keep) + "n long, chosen long, key binary, short long"), "rows")
    parts = parts_for(rows.agg(F.sum("chosen")).first()[0])
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("chosen").alias("chosen"), F.first("short").alias("short"))
    blobs = d.mapInArrow(lambda it: _blobs(it, parts), "part int, tokens binary, owners binary, classes binary")
    shared = blobs.repartitionById(parts, F.col("part")).mapInArrow(lambda it: _shared(it, parts), "part int, classes binary, counts binary")
    shared = shared.repartitionById(parts, F.col("part")).mapInArrow(_summed, "short long, shared long")
    alive = classes.join(shared, "short", "left").where("coalesce(shared, 0) >= chosen - n div 5")
    alive = saved(alive.select("key", "doc_id"), "alive")
    # texts of survivors: by a bucket of their id first, of which there is a fixed number
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket")
    few = d.withColumn("bucket", bucket).join(F.broadcast(alive.select(bucket).distinct()), "bucket", "left_semi").select("text")
    nodes = few.mapInArrow(_nodes, "chunk long, key binary, n long, tokens binary").where("n > 0")
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    node_parts = parts_for(nodes.agg(F.sum("n")).first()[0])
    counts = nodes.select("chunk", "tokens").mapInArrow(lambda it: _chunk_counts(it, node_parts), "part int, chunk long, tokens binary, counts binary")
    known = counts.repartitionById(node_parts, F.col("part")).mapInArrow(_frequencies, "chunk long, tokens binary, df binary")
    pre = nodes.select("chunk", "node", "n", "tokens").groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_prefixes, "node long, n long, weight double, a binary, b binary")
    pre = saved(pre, "prefixes")
    post = pre.select("a", "node", "weight").mapInArrow(_postings, "token long, node long, weight double")
    post = saved(post, "postings")
    centre = post.groupBy("token").agg(F.max(F.struct("weight", "node"))["node"].alias("b"), F.count("*").alias("m")).where("m > 1")
    edges = post.join(centre, "token").select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    comp = saved(components(edges).select("node", F.col("root").alias("comp")), "candidates")
    members = nodes.select("node", "tokens").join(pre, "node").join(comp, "node")
    per = comp.join(pre.select("node", "n"), "node").groupBy("comp").agg(F.ceil(F.greatest(F.sum("n") / BLOCK, F.count("*") / MEMBERS)).cast("int").alias("blocks"), F.count("*").alias("members"))
    per = saved(per.withColumn("size", F.when(F.col("blocks") > 1, 2).otherwise(1)), "sizes")
    small = members.join(per.where("size = 1").select("comp"), "comp", "left_semi")
    found = small.select("comp", "node", F.lit(True).alias("query"), F.col("node").alias("label"), "weight", "tokens", "a", "b").groupBy("comp").applyInArrow(_resolve, "a long, b long")
    if per.where("size > 1").limit(1).count():
        found = found.unionByName(_large(saved(members, "members"), per))
    linked = components(found)
    ids = nodes.select("node", "key").join(linked, "node").join(classes.select("key", "doc_id"), "key")
    least = ids.groupBy("root").agg(F.min("doc_id").alias("component"))
    groups = ids.join(least, "root").groupBy("key").agg(F.min("component").alias("component"))
    return rows, groups


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links reach, for each row, and the columns of keep.

    A null text or one without words has no shingles and is linked with nothing; fewer than five words
    are one shingle. Rows of one doc_id are judged each by its own text. Null ids stay null, and count in
    no minimum. Other columns are ignored.
    """
    rows, groups = join_classes(docs, keep)
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id", *keep]
    some = rows.where("n > 0")
    own = some.groupBy("key").agg(F.min("doc_id").alias("own"), F.count("*").alias("copies"))
    own = saved(own.join(groups, "key", "left").select("key", "copies", F.least("own", "component").alias("component_id")), "classes")
    # classes that hold at least one row in HOT are HOT at most: these go to every task, the others' rows to their key's
    hot = F.broadcast(own.where(F.col("copies") * HOT >= max(1, rows.count())).select("key", "component_id"))
    often = some.join(hot, "key").select(cols)
    seldom = some.join(hot, "key", "left_anti").join(own, "key").select(cols)
    return often.unionByName(seldom).unionByName(rows.where("n = 0").withColumn("component_id", F.col("doc_id")).select(cols))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id, of equal rows any. Rows without words or an id stay."""
    found = saved(near_duplicates(docs.select("doc_id", "text", *row_hashes(docs)), ROW), "found")
    found = found.where("n_shingles > 0 and component_id is not null")
    first = found.groupBy("component_id").agg(F.min(F.struct("doc_id", *ROW)).alias("f")).select(*[F.col("f")[c].alias(c) for c in ROW])
    gone = saved(found.select(*ROW).distinct().join(first, list(ROW), "left_anti"), "gone")
    again = saved(found.groupBy(*ROW).count().where("count > 1").select(*ROW), "again")
    return without(docs, gone, again if again.limit(1).count() else None)
