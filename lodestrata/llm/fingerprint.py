"""Quartile bucket digests of documents.

A text's UTF-8 bytes are counted as hashed triplets in BUCKETS buckets. The digest holds, in hex, the
logarithm of the length, the ratios of the quartiles of the counts, and two bits per bucket that say in
which quartile its count lies. Two digests differ by a score that adds up the steps between their
fields and is bounded by MOST; the likeness is 1 - score / MOST. Equal texts have equal digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import saved
from lodestrata.runtime import lean, ship

BUCKETS = 128
#: Penalties: a bucket's step of 1, 2 or 3 quartiles; a step of the length's code; a step of a ratio's code.
STEP = np.array([0, 1, 2, 6])
LENGTH_STEP, LENGTH_MOST, RATIO_STEP, RATIO_MOST = 4, 60, 3, 24
#: The score's bound: 6 for each bucket, and the fields of the head.
MOST = 6 * BUCKETS + LENGTH_MOST + 2 * RATIO_MOST
#: Bytes hashed at once, so that the arrays of a long text stay small.
SLICE = 1 << 22


def counts(data: bytes) -> np.ndarray:
    """How many byte triplets fall into each bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(len(data) - 2, 0), SLICE):
        b = np.frombuffer(data, np.uint8, min(SLICE + 2, len(data) - at), at).astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out += np.bincount((h >> np.uint32(25)).astype(np.intp), minlength=BUCKETS)
    return out


def digest(data: bytes) -> str:
    """Hex of the length's code, the two ratios' codes and the buckets' quartiles, 2 + 2 + 64 digits."""
    c = counts(data)
    low, mid, high = (int(x) for x in np.partition(c, (31, 63, 95))[[31, 63, 95]])
    code = ((c > low).astype(np.uint8) + (c > mid) + (c > high)).reshape(-1, 4)
    body = (code[:, 0] << 6 | code[:, 1] << 4 | code[:, 2] << 2 | code[:, 3]).astype(np.uint8).tobytes()
    size = min(255, int(np.log(max(len(data), 1)) * 10 + 0.5))
    ratio = (low * 15 // high, mid * 15 // high) if high else (0, 0)
    return bytes([size, ratio[0] << 4 | ratio[1]]).hex() + body.hex()


def score(a: str, b: str) -> int:
    """The difference of two digests, from 0 to MOST."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    quart = lambda v: np.stack([v >> 6, v >> 4 & 3, v >> 2 & 3, v & 3])
    total = int(STEP[np.abs(quart(x[2:]).astype(int) - quart(y[2:]))].sum())
    total += min(LENGTH_MOST, LENGTH_STEP * abs(int(x[0]) - int(y[0])))
    for shift in (4, 0):
        total += min(RATIO_MOST, RATIO_STEP * abs((int(x[1]) >> shift & 15) - (int(y[1]) >> shift & 15)))
    return total


def likeness(a: str, b: str) -> float:
    return 1.0 - score(a, b) / MOST


def edited(text: str, other: str) -> str:
    """text with its last third replaced by as many characters from the start of other, or all of them."""
    k = len(text) // 3
    return text[: len(text) - k] + other[:k]


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Up to parts - 1 ids that cut the ids into ranges of about equal numbers."""
    at = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10000)).first()[0] if parts > 1 else None
    return sorted(set(at or []))


@lean
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range in descending order, and behind them the row that follows the range; each row meets the next."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    last = None
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names)
        rows.clear()
        return out

    for b in batches:
        for part, doc_id, ghost, text in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "ghost", "text")), strict=True):
            text = text or ""
            own = digest(text.encode())
            if last and last[0] == part:
                _, was, prev, prev_digest = last
                changed = edited(prev, text).encode()
                d = digest(changed)
                rows.append((was, len(prev), hashlib.sha256(changed).hexdigest(), prev_digest, d, likeness(prev_digest, d), likeness(prev_digest, own)))
            last = None if ghost else (part, doc_id, text, own)
            if len(rows) >= 2000:
                yield batch()
    yield batch()


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Digests of every text and of its edited form, whose last third comes from the next document.

    The next document is the one that follows in descending doc_id; after the last comes the first. Null
    ids stand last; rows of one id are ordered by text, nulls first. A null text is empty. A single row is
    its own next. Documents are dealt to ranges of ids in one shuffle; the first row of each range is sent
    along with the range before it, so that only as many rows as ranges travel twice.
    """
    ship(docs.sparkSession)
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = _bounds(d, parts)
    # range 0 holds the highest ids; null ids fall into the last
    n = len(cuts) + 1
    above = F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    d = d.withColumn("part", F.when(F.col("doc_id").isNull(), n - 1).otherwise(above).cast("int"))
    heads = d.groupBy("part").agg(F.max("doc_id").alias("head"))
    # ranges without rows are passed over; at most one row for each range is collected
    seen = sorted((r[0], r[1]) for r in heads.collect())
    if not seen:
        return d.select("doc_id", "text", "part", F.lit(False).alias("ghost")).mapInArrow(_neighbours, SCHEMA)
    turn = [(p, seen[i - 1][0], h) for i, (p, h) in enumerate(seen)]
    table = d.sparkSession.createDataFrame(turn, "part int, before int, head long")
    # a head id may have several rows: the first of them by text goes along
    first = d.join(F.broadcast(table), "part").where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("before", "doc_id").agg(F.min(F.struct(F.col("text").isNotNull().alias("f"), "text"))["text"].alias("text"))
    first = saved(first.select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("ghost")), "heads")
    both = d.select("doc_id", "text", "part", F.lit(False).alias("ghost")).unionByName(first)
    dealt = both.repartitionById(n, F.col("part")).sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))
    return dealt.mapInArrow(_neighbours, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
