"""Lloyd's k-means in exact integers, by two trees.

Vectors lie in chunks of one task each, and every chunk keeps a cover tree over its vectors, built once: centres are
taken farthest first, a centre's level is the power of two under its distance to those before it, its parent the nearest
centre of the level above. So centres of a level are farther apart than its scale (separation), each lies within the
scale of its parent (covering) and stays a centre below (nesting). Each round builds such a tree over the centroids
as well, and walks both together, level by level: a pair of nodes is dropped if even its nearest points are
farther apart than some other centroid is from all vectors of the node. A node left with one centroid goes
to it whole; of the others, leaves are compared exactly.

Bounds are floats with slack, comparisons integers: ties go to the smaller number. What travels in a round is
a sum for each task and centroid; the centroids, k of them, go through the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import saved
from lodestrata.runtime import lean, ship

#: Components of a vector, centroids, rounds, what a component is multiplied by, and the seed of the first centroids.
WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Vectors of a chunk.
CHUNK = 1024
#: Components of a larger magnitude, once multiplied, count as not finite; distances that a long does not hold count as its largest value.
MOST, LONG = 1 << 62, (1 << 63) - 1
#: Up to this magnitude integers of 64 bits hold every distance; beyond it Python's integers are used.
SMALL = 1 << 27


class Tree(NamedTuple):
    """The points in the tree's order, and its nodes breadth first: the place of a node's centre in that order, the greatest
    distance from it to a point below, the range of the node's points, and the range of its children."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of a and of b, in floats."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0))


def cover_tree(points: np.ndarray) -> Tree:
    """A cover tree over points (floats, one a row, one at least). Equal points share a leaf."""
    n = len(points)
    d = _apart(points, points)
    np.fill_diagonal(d, 0)
    # farthest first: the scale at which a point becomes a centre
    centres, level, nearest, owner = [0], [math.inf], d[0].copy(), np.zeros(n, np.int64)
    slack = 1e-7 * (float(np.sqrt((points * points).sum(1)).max()) + 1)
    while len(centres) < n and nearest[(p := int(nearest.argmax()))] > slack:
        level.append(math.ceil(math.log2(nearest[p])) - 1)  # apart by more than 2 ** level, and within twice that of a centre
        centres.append(p)
        closer = d[p] < nearest
        owner[closer] = p
        np.minimum(nearest, d[p], out=nearest)
    levels = np.array(level)
    at = np.array(centres)
    # nodes from the top: a centre that gets children at a level goes on below as a child of its own
    node_of, centre, kids = {0: 0}, [0], [[]]

    def node(p: int) -> int:
        centre.append(p)
        kids.append([])
        return len(centre) - 1

    for scale in sorted(set(level[1:]), reverse=True):
        new = np.flatnonzero(levels == scale)
        above = at[: int(new[0])]
        inner: dict[int, int] = {}
        for p, parent in zip(at[new].tolist(), above[d[np.ix_(at[new], above)].argmin(axis=1)].tolist(), strict=True):
            if parent not in inner:
                inner[parent] = node_of[parent]
                node_of[parent] = node(parent)
                kids[inner[parent]].append(node_of[parent])
            node_of[p] = node(p)
            kids[inner[parent]].append(node_of[p])
    # breadth first, so that children stand together
    rows, place = [0], 0
    first, last = [], []
    while place < len(rows):
        first.append(len(rows))
        rows += kids[rows[place]]
        last.append(len(rows))
        place += 1
    # a node's points stand together: each leaf's are those nearest to its centre
    held: dict[int, list[int]] = {}
    for point, p in enumerate(owner.tolist()):
        held.setdefault(node_of[p], []).append(point)
    size = [0] * len(rows)
    for k in range(len(rows) - 1, -1, -1):
        size[k] = sum(size[first[k] : last[k]]) if last[k] > first[k] else len(held[rows[k]])
    start = [0] * len(rows)
    order = np.empty(n, np.int64)
    radius = np.empty(len(rows))
    for k in range(len(rows)):
        into = start[k]
        for c in range(first[k], last[k]):
            start[c] = into
            into += size[c]
        if last[k] == first[k]:
            order[into : into + size[k]] = held[rows[k]]
    for k in range(len(rows)):
        radius[k] = d[centre[rows[k]], order[start[k] : start[k] + size[k]]].max()
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    begin = np.array(start)
    return Tree(order, back[[centre[k] for k in rows]], radius, begin, begin + np.array(size), np.array(first), np.array(last))


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, one after the other, and which range each is of."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return first[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), of


def candidates(t: Tree, x: np.ndarray, ct: Tree, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of a vector, place of a centroid) among which every vector's nearest centroids are. x, c: floats in the trees' orders."""
    slack = 1e-6 * (float(np.abs(x).max()) + float(np.abs(c).max()) + 1) * math.sqrt(x.shape[1])
    bound = np.full(len(t.centre), np.inf)
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    leaf, c_leaf = t.first == t.last, ct.first == ct.last
    out: list[tuple[np.ndarray, np.ndarray]] = []
    while len(q):
        d = np.empty(len(q))
        for at in range(0, len(q), 1 << 13):
            diff = x[t.centre[q[at : at + (1 << 13)]]] - c[ct.centre[r[at : at + (1 << 13)]]]
            d[at : at + (1 << 13)] = np.sqrt((diff * diff).sum(axis=1))
        np.minimum.at(bound, q, d + t.radius[q])  # the centre of a node of centroids is a centroid
        keep = d - t.radius[q] - ct.radius[r] <= bound[q] + slack
        q, r = q[keep], r[keep]
        alone = np.bincount(q, minlength=len(leaf))[q] == 1
        done = c_leaf[r] & (leaf[q] | alone)
        out.append((q[done], r[done]))
        q, r = q[~done], r[~done]
        # both sides go down where they can
        kid, of = _spread(np.where(leaf[q], q, t.first[q]), np.where(leaf[q], q + 1, t.last[q]))
        np.minimum.at(bound, kid, bound[q[of]])
        q, r = kid, r[of]
        kid, of = _spread(np.where(c_leaf[r], r, ct.first[r]), np.where(c_leaf[r], r + 1, ct.last[r]))
        q, r = q[of], kid
    q, r = (np.concatenate(s) for s in zip(*out, strict=True))
    point, of = _spread(t.start[q], t.end[q])
    r = r[of]
    one, of = _spread(ct.start[r], ct.end[r])
    return point[of], one


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that stand side by side."""
    diff = x - c
    return (diff * diff).sum(axis=1)


def assign(t: Tree, x: np.ndarray, centroids: list[list[int]], ct: Tree) -> tuple[np.ndarray, list[int]]:
    """The number of the nearest centroid of each vector of a chunk, of equally near ones the smallest, and the exact squared distance."""
    c = np.array(centroids, object)
    small = max(abs(int(x.max())), abs(int(x.min()))) < SMALL and max(abs(v) for row in centroids for v in row) < SMALL
    c = c.astype(np.int64) if small else c
    mine = x if small else x.astype(object)
    point, one = candidates(t, x.astype(np.float64), ct, c[ct.order].astype(np.float64))
    number = ct.order[one]
    d = np.empty(len(point), np.int64 if small else object)
    for at in range(0, len(point), 1 << 13):
        d[at : at + (1 << 13)] = _squared(mine[point[at : at + (1 << 13)]], c[number[at : at + (1 << 13)]])
    order = np.lexsort((number, d, point)) if small else np.array(sorted(range(len(point)), key=lambda i: (point[i], d[i], number[i])))
    best = order[np.concatenate(([True], np.diff(point[order]) > 0))]
    return number[best], [int(v) for v in d[best]]


_ARRAYS = ("centre", "radius", "start", "end", "first", "last")


@lean
def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of vectors with their trees; the vectors stand in the tree's order."""

    def made(ids: list, vectors: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(vectors)
        t = cover_tree(x.astype(np.float64))
        x = x[t.order]
        small = len(x) and max(abs(int(x.max())), abs(int(x.min()))) < 1 << 31
        cols = {"ids": pa.array([[ids[i] for i in t.order]], pa.list_(pa.int64())), "vectors": pa.array([x.astype(np.int32 if small else np.int64).tobytes()], pa.binary()), "bytes": pa.array([4 if small else 8], pa.int32())}
        cols |= {k: pa.array([getattr(t, k).astype(np.float64 if k == "radius" else np.int32).tobytes()], pa.binary()) for k in _ARRAYS}
        return pa.RecordBatch.from_pydict(cols)

    ids: list = []
    vectors: list[np.ndarray] = []
    for b in batches:
        x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        mine = b.column("vec_id").to_pylist()
        at = 0
        while at < len(x):
            end = at + CHUNK - len(ids)
            vectors.append(x[at:end])
            ids += mine[at:end]
            at = end
            if len(ids) == CHUNK:
                yield made(ids, vectors)
                ids, vectors = [], []
    if ids:
        yield made(ids, vectors)


def _opened(b: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, Tree]]:
    for i in range(b.num_rows):
        row = {c: b.column(c)[i].as_py() for c in b.schema.names}
        ids = row["ids"]
        x = np.frombuffer(row["vectors"], np.int32 if row["bytes"] == 4 else np.int64).astype(np.int64).reshape(len(ids), -1)
        yield ids, x, Tree(np.arange(len(ids)), *(np.frombuffer(row[k], np.float64 if k == "radius" else np.int32) for k in _ARRAYS))


def _sums(centroids: list[list[int]]):
    @lean
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task: each centroid's number of vectors and their sums."""
        ct = cover_tree(np.array(centroids, np.float64))
        total = [[0] * WIDTH for _ in centroids]
        n = np.zeros(len(centroids), np.int64)
        for b in batches:
            for _, x, t in _opened(b):
                number, _ = assign(t, x, centroids, ct)
                n += np.bincount(number, minlength=len(n))
                small = max(abs(int(x.max())), abs(int(x.min()))) < 1 << 50
                for k in np.unique(number).tolist():
                    own = (x if small else x.astype(object))[number == k].sum(axis=0).tolist()
                    total[k] = [u + v for u, v in zip(total[k], own, strict=True)]
        has = np.flatnonzero(n).tolist()
        cols = ([k for k in has for _ in range(WIDTH)], [i for _ in has for i in range(WIDTH)], [int(n[k]) for k in has for _ in range(WIDTH)], [v for k in has for v in total[k]])
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)), strict=True)], ["cluster", "i", "n", "total"])

    return summed


def _nearest(centroids: list[list[int]]):
    @lean
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ct = cover_tree(np.array(centroids, np.float64))
        for b in batches:
            for ids, x, t in _opened(b):
                number, d = assign(t, x, centroids, ct)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array([min(v, LONG) for v in d], pa.int64())], ["vec_id", "cluster", "distance"])

    return found


def whole_vectors(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vec_id, vector): vectors of width components, none null or not finite, each component times SCALE and rounded down."""
    x = F.col("embedding")
    scaled = F.transform(x, lambda v: v.cast("double") * SCALE)
    # a comparison with null is null and with NaN false or true by side: both ends are asked
    fine = F.forall(scaled, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= float(MOST)))
    return vectors.where((F.size(x) == width) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(scaled, lambda v: F.floor(v).cast("long")).alias("vector"))


def _drawn(vec_id: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{SEED}:"), vec_id.cast("string")), 256)


def lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each kept vector.

    Rows whose vector is null, of another width or with a null, infinite or undefined component are left out; so are
    components beyond MOST. Null ids are drawn as first centroids only where ids run out; rows of one id draw alike, the
    lesser vector first. Fewer vectors than clusters give as many centroids as vectors; no vectors, no rows. Sums and
    distances are exact; a distance or inertia beyond a long's range is its largest value. Other columns are ignored.
    """
    spark = ship(vectors.sparkSession)
    whole = whole_vectors(vectors)
    # clusters rows, a bounded number
    centroids = [list(r.vector) for r in whole.orderBy(_drawn(F.col("vec_id")).asc_nulls_last(), "vector").limit(clusters).collect()]
    shape = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], shape)
    chunks = whole.mapInArrow(_chunks, "ids array<long>, vectors binary, bytes int, " + ", ".join(f"{k} binary" for k in _ARRAYS))
    chunks = saved(chunks, "trees")
    for _ in range(rounds):
        sums = chunks.mapInArrow(_sums(centroids), "cluster int, i int, n long, total decimal(38,0)").groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        for r in sums.collect():  # clusters times WIDTH rows at most
            centroids[r.cluster][r.i] = int(r.total) // r.n
    rows = saved(chunks.mapInArrow(_nearest(centroids), "vec_id long, cluster int, distance long"), "assigned")
    per = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each cluster
    every = min(LONG, sum(int(r.s) for r in per))
    names = [(r.cluster, min(LONG, int(r.s)), every, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in per]
    table = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    gap = lambda a, b: f"list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
    out = [
        f"WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS c, q FROM v ORDER BY 1 LIMIT {CLUSTERS})",
    ]
    for k in range(ROUNDS + 1):
        out.append(f"a{k} AS (SELECT * FROM (SELECT vec_id, v.q AS q, c, {gap('v.q', f'c{k}.q')} AS d FROM v, c{k}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if k < ROUNDS:
            out.append(f"m{k} AS (SELECT c, list(m ORDER BY i) AS q FROM (SELECT c, i, CAST(floor(sum(q[i]) / count(*)) AS BIGINT) AS m FROM a{k}, (SELECT unnest(range(1, {WIDTH + 1})) AS i) GROUP BY c, i) GROUP BY c)")
            out.append(f"c{k + 1} AS (SELECT c{k}.c AS c, coalesce(m{k}.q, c{k}.q) AS q FROM c{k} LEFT JOIN m{k} ON m{k}.c = c{k}.c)")
    k = ROUNDS
    return ", ".join(out) + f" SELECT vec_id, CAST(a{k}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{k}.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{k}.q, ',')) AS centroid_sha256 FROM a{k} JOIN c{k} ON c{k}.c = a{k}.c"


OP11_SQL = _sql()
