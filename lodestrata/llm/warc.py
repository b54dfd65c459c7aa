"""Web archives and a globally ordered index of their captures.

Pages are written as WARC/1.0 records, equal payloads as revisits of one response, and read back record
by record. What is read from an archive is a run of captures, sorted by URL key and time. Runs are cut
at common key ranges; in each range a loser tree merges the runs' slices, so the ranges, one behind the
other, hold the capture histories of all URLs in order. An archive holds at most RECORDS records. The
index tells where each record begins in its archive's unpacked bytes, and how many it has.

Cases: a null html is an empty payload, a null url is left out of the record and read back as null, a
null page_id can be no revisit. Rows of one page_id and payload are all the response, or all revisits of
a larger page_id. Payloads under LEAST bytes are never revisits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import saved, scratch_path
from lodestrata.runtime import lean, ship

#: Bytes from which an equal payload is written as a revisit.
LEAST = 1000
#: Records of an archive at most: it is read back as a whole.
RECORDS = 20_000
#: Parts into which the rows of one digest are dealt when they look up their response.
SALTS = 16
#: Pages have no capture time: it is made up from page_id, in seconds after this one.
EPOCH = 1_577_836_800
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INDEX = "page_id long, url string, urlkey string, captured string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, place long, record_offset long, record_bytes long"


def _keys(pages: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n"))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that revisit another; a digest held by many rows is looked up in SALTS parts."""
    k = _keys(pages).where(f"n >= {LEAST} and page_id is not null")
    dups = k.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").select("digest", "refers_to")
    dups = dups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    k = k.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return k.join(dups, ["digest", "salt"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write a record per page. The writer ends each with the two empty lines that WARC asks for; payloads travel once, to meet their revisits."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("body"))
    p = p.withColumn("digest", F.sha1(F.col("body").cast("binary"))).withColumn("n", F.octet_length("body"))
    p = p.join(revisits(pages), ["page_id", "digest"], "left")
    crlf = "\r\n"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("n").cast("string"), F.lit(crlf * 2))
    again = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("body")))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.0{crlf}WARC-Type: "), F.when(again, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{crlf}WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f">{crlf}WARC-Date: "), when,
        F.coalesce(F.concat(F.lit(f"{crlf}WARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(again, F.concat(F.lit(f"{crlf}WARC-Profile: {PROFILE}{crlf}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "), F.octet_length(block).cast("string"), F.lit(crlf * 2),
    )
    p.select(F.concat(head, block).alias("value")).write.mode("overwrite").option("lineSep", crlf * 2).option("compression", compression).option("maxRecordsPerFile", RECORDS).text(path)


class Records:
    """The records of an archive's bytes, plain or gzipped, as (headers, block, offset, length), both in unpacked bytes. Blocks are found by Content-Length alone."""

    def __init__(self, data: bytes, step: int = 1 << 20):
        self.data, self.at, self.step = data, 0, step
        self.gz = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None
        self.buf, self.pos, self.done = (bytearray(), 0, 0) if self.gz else (data, 0, 0)

    def _more(self) -> bool:
        if not self.gz or self.at >= len(self.data):
            return False
        if self.pos:
            del self.buf[: self.pos]
            self.done += self.pos
            self.pos = 0
        self.buf += self.gz.decompress(self.data[self.at : self.at + self.step])
        self.at += self.step
        while self.gz.eof and self.gz.unused_data:  # members one behind the other
            rest, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            self.buf += self.gz.decompress(rest)
        return True

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
        while True:
            while (end := self.buf.find(b"\r\n\r\n", self.pos)) < 0:
                if not self._more():
                    if bytes(self.buf[self.pos :]).strip():
                        raise ValueError("an archive ends inside a record")
                    return
            lines = bytes(self.buf[self.pos : end]).decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a record: {lines[0][:40]!r}")
            head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(head["content-length"])
            start = end + 4 - self.pos
            while len(self.buf) - self.pos < start + size + 4 and self._more():
                pass
            block = bytes(self.buf[self.pos + start : self.pos + start + size])
            if len(block) < size:
                raise ValueError("an archive ends inside a record")
            yield head, block, self.done + self.pos, start + size
            self.pos += start + size + 4


def urlkey(url: str | None) -> str:
    """The host's labels from the right, then path and query: pages of a domain stand together."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url or "", re.S)
    return ",".join(reversed(m[1].lower().split("."))) + ")" + (m[2] or "/")


def _page(urn: str | None) -> int | None:
    got = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(got) if got else None


@lean
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            rows = []
            for head, block, offset, length in Records(content.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                n = int(re.search(rb"(?i)\ncontent-length:\s*(\d+)", http)[1])
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
                url = head.get("warc-target-uri")
                rows.append((urlkey(url), head["warc-date"], _page(head["warc-record-id"]), url, kind, _page(head.get("warc-refers-to")), digest, n, offset, length))
            rows.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
            name = path.rpartition("/")[2]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 10
            text, number = pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([
                pa.array(cols[2], number), pa.array(cols[3], text), pa.array(cols[0], text), pa.array(cols[1], text), pa.array(cols[4], text), pa.array(cols[5], number), pa.array(cols[6], text),
                pa.array(cols[7], number), pa.array([name] * len(rows), text), pa.array(range(len(rows)), number), pa.array(cols[8], number), pa.array(cols[9], number),
            ], [c.split()[0] for c in INDEX.split(", ")])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archives under path. Those of one archive are a run: `place` counts them in order of urlkey, captured and page_id."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, INDEX)


class LoserTree:
    """Merges sorted lists. Each inner node keeps the loser of its match; only the path of the last winner is played again."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.head = [self._head(i) for i in range(self.k)]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _head(self, i: int):
        done = i >= len(self.runs) or self.at[i] >= len(self.runs[i])
        return (1,) if done else (0, self.key(self.runs[i][self.at[i]]), i)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # the first of two to come waits here
                self.tree[node] = i
                return
            if self.head[other] < self.head[i]:
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while True:
            i = self.tree[0]
            if i < 0 or self.head[i] == (1,):
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.head[i] = self._head(i)
            self._play(i)


@lean
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows come run by run, each in its order; they leave merged."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    t = pa.concat_tables(tables)
    urls, when, ids, runs = (t.column(c).to_pylist() for c in ("urlkey", "captured", "page_id", "archive"))
    cut = [i for i in range(len(runs)) if not i or runs[i] != runs[i - 1]]
    lists = [list(range(a, z)) for a, z in zip(cut, [*cut[1:], len(runs)], strict=True)]
    order = list(LoserTree(lists, lambda i: (urls[i], when[i], ids[i] is not None, ids[i] or 0)))
    yield from t.take(pa.array(order, pa.int64())).combine_chunks().to_batches(max_chunksize=1 << 16)


def merged(runs: DataFrame) -> DataFrame:
    """The runs in one global order by urlkey, captured and page_id: partition after partition, row after row."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartitionByRange(parts, "urlkey", "captured", "page_id").sortWithinPartitions("archive", "place").mapInArrow(_merge, INDEX)


def op4(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    index = merged(saved(read_runs(spark, path), "runs"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "archive", "record_offset", "record_bytes")


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
d AS (SELECT page_id, n, sha1(h) AS digest FROM p),
r AS (SELECT digest, max(page_id) AS refers_to FROM d WHERE n >= {LEAST} GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < refers_to THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < refers_to THEN refers_to END AS refers_to
FROM d LEFT JOIN r USING (digest)
"""
