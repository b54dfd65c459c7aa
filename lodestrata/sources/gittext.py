"""Captured texts of a version-control tool as Spark sources: logs, unified diffs and lists of changed names.

`spark.read.format("git_text")` reads files of any length in ranges of bytes. A record belongs to the range in which its
separator begins, wherever it ends, so a cut inside a separator or a record neither loses nor doubles one. Files are
opened through Arrow's file systems: a URI of file, hdfs, s3 or gs, or a path that all executors share.
Records are taken apart by column expressions in `lodestrata.operators.changes`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.runtime import ship

#: What stands before each commit of a log, and between the fields of its first line.
LOG_RECORD, LOG_FIELD = "<<<SEP>>>", "<<<F>>>"
#: Fixed value: how a file's part of a diff begins.
DIFF_RECORD = "diff --git "
#: The arguments of the captures, and the revisions that changed names are asked of, the first that there is.
LOG_ARGS = ("log", f"--format={LOG_RECORD}%h{LOG_FIELD}%ad{LOG_FIELD}%an{LOG_FIELD}%s", "--date=short", "--numstat")
DIFF_ARGS = {"unstaged": ("diff", "--no-color"), "staged": ("diff", "--cached", "--no-color"), "commit": ("show", "--format=", "--no-color", "{ref}"), "branch": ("diff", "--no-color", "{ref}...HEAD")}
NAME_REFS = ("HEAD~5", "HEAD~1")
#: Bytes of a range, and bytes read at once.
SPLIT, BLOCK = 32 << 20, 1 << 20
#: Bytes of records that go to Spark at once.
BATCH = 1 << 20


def records(f: BinaryIO, lo: int, hi: int, separator: bytes, at_line_start: bool, block: int = BLOCK) -> Iterator[tuple[int, bytes]]:
    """(position, text) of the records whose separator begins in [lo, hi) of a file, without the separator.

    With at_line_start, a separator counts only at the start of a line and the text before the first is no record;
    else what precedes the first separator is one, at position 0. Memory holds one record and a block.
    """
    base = lo - 1 if at_line_start and lo else lo
    f.seek(base)
    buf = bytearray()
    # where the record that is being read starts, and how many bytes of separator it has
    current, width = (0, 0) if lo == 0 and not at_line_start else (None, len(separator))
    search, ended = lo - base, False
    while True:
        i = buf.find(separator, search)
        if i >= 0 and at_line_start and not (buf[i - 1] == 10 if i else base == 0):
            search = i + 1
            continue
        if i >= 0:
            if current is not None and (width or i):
                yield current, bytes(buf[current - base + width : i])
            if base + i >= hi:
                return
            current, width = base + i, len(separator)
            del buf[:i]
            base += i
            search = len(separator)
            continue
        if ended:
            if current is not None and (width or buf):
                yield current, bytes(buf[current - base + width :])
            return
        search = max(search, len(buf) - len(separator) + 1)
        if current is None:
            if base + search >= hi:
                return
            gone = max(0, search - 1)  # the byte before a separator tells whether a line starts there
            del buf[:gone]
            base += gone
            search -= gone
        more = f.read(block)
        ended = not more
        buf += more


@dataclass
class Range(InputPartition):
    path: str
    lo: int
    hi: int


class GitTextReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("git_text needs a path")
        kind = options.get("records", "log")
        if kind not in ("log", "diff"):
            raise ValueError(f"records are log or diff, not {kind}")
        self.path, self.kind, self.split = options["path"], kind, int(options.get("splitbytes", SPLIT))

    def partitions(self) -> list[Range]:
        store, root = fs.FileSystem.from_uri(self.path)
        at = store.get_file_info(root)
        if at.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [at] if at.is_file else [x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and not x.base_name.startswith((".", "_"))]
        return [Range(x.path, lo, min(lo + self.split, x.size)) for x in sorted(found, key=lambda x: x.path) for lo in range(0, x.size, self.split)]

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks once even where there are no ranges
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        separator = (LOG_RECORD if self.kind == "log" else DIFF_RECORD).encode()
        at, texts, held = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(texts, pa.string())], ["file", "pos", "record"])

        with store.open_input_file(part.path) as f:
            for pos, raw in records(f, part.lo, part.hi, separator, self.kind == "diff"):
                at.append(pos)
                texts.append(raw.decode("utf-8", "replace"))
                held += len(raw)
                if held >= BATCH:
                    yield batch()
                    at, texts, held = [], [], 0
        if at:
            yield batch()


class GitText(DataSource):
    """Rows file, pos (the byte at which the record starts) and record. Options: path, records (log or diff), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "git_text"

    def schema(self) -> str:
        return "file string, pos long, record string"

    def reader(self, schema) -> GitTextReader:
        return GitTextReader({k.lower(): v for k, v in self.options.items()})


def git_text(spark: SparkSession, path: str, kind: str = "log", split: int = SPLIT) -> DataFrame:
    """Records of captured logs or diffs under a path."""
    ship(spark).dataSource.register(GitText)
    return spark.read.format("git_text").option("records", kind).option("splitBytes", split).load(path)


def changed_names(spark: SparkSession, folder: str, refs: tuple[str, ...] = NAME_REFS) -> DataFrame:
    """path: the names in the capture of the first ref that was captured (a file or folder of its name); without one, none."""
    from pyspark.errors import AnalysisException

    for ref in refs:
        try:
            d = spark.read.text(f"{folder}/{ref}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        return d.where("value <> ''").select(d.value.alias("path")).distinct()
    return spark.createDataFrame([], "path string")
