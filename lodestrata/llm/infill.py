"""Fill-in-middle transformation by a parallel automaton scan.

Texts are cut into chunks. An automaton reads them: it knows whether it stands in white space or in a word and how
much of a marker it has just read, and it counts the ends of words and the markers. What a chunk does to it is
a Summary: for each state at the chunk's start, the state at its end and both counts. Summaries of neighbours
compose, and composing is associative, so no chunk waits for another; the composed ones give each chunk the state
and the number of tokens that it starts with, and so tell which chunk holds a cut. Only that chunk is searched.

A text of one chunk is done where it lies. Longer ones are dealt to tasks by the chunk, twice: for the summaries and
for the search. A row of Spark holds 2 GB at most and thus a bounded number of chunks. Texts themselves are shuffled as
chunks only, and only the long ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import saved
from lodestrata.runtime import lean, ship

#: What marks the parts in an output.
PRE, SUF, MID = "<P>", "<S>", "<M>"
#: Share of plain texts and, of the others, of those with the suffix first, in percent; the seed of the draws.
PLAIN, SPM, SEED = 50, 80, 42
#: Code points of a chunk.
CHUNK = 1 << 16
#: Rows of a batch that are turned into Python values at once.
ROWS = 64
#: Texts that end in each state: in white space or at the start, in a word, in a word's "<", in a word's "<P", "<S" or "<M".
STATES = (b" ", b"a", b"<", b"<P")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = re.compile(rb"<[PSM]>")


class Summary(NamedTuple):
    """What a piece of text does, for each state that it may start in: the state at its end, ends of words, markers."""

    state: tuple[int, ...]
    ends: tuple[int, ...]
    marks: tuple[int, ...]

    def then(self, after: Summary) -> Summary:
        """The summary of this piece and the one after it as one."""
        to = self.state
        return Summary(tuple(after.state[q] for q in to), tuple(n + after.ends[q] for n, q in zip(self.ends, to, strict=True)), tuple(n + after.marks[q] for n, q in zip(self.marks, to, strict=True)))


#: The summary of no text.
NOTHING = Summary((0, 1, 2, 3), (0,) * 4, (0,) * 4)


def _state(tail: bytes) -> int:
    """The state after a text with this end of two bytes or more."""
    if _SPACE[tail[-1]]:
        return 0
    if tail[-1:] == b"<":
        return 2
    return 3 if tail[-2:-1] == b"<" and tail[-1:] in b"PSM" else 1


def _word_ends(data: bytes) -> np.ndarray:
    """Places of the white space that follows a word inside data."""
    gap = _SPACE[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(gap[1:] & ~gap[:-1]) + 1


def summary(data: bytes) -> Summary:
    """Of a chunk in UTF-8: counted once, and for each state at its start what its first bytes add."""
    if not data:
        return NOTHING
    ends, marks = len(_word_ends(data)), len(_MARK.findall(data))
    opens = bool(_SPACE[data[0]])
    return Summary(
        tuple(_state(b" " + s + data[-2:] if len(data) < 2 else data[-2:]) for s in STATES),
        tuple(ends + (opens and q > 0) for q in range(4)),
        tuple(marks + (1 if _MARK.match(s + data[:2]) else 0) if q > 1 else marks for q, s in enumerate(STATES)),
    )


def place(data: bytes, state: int, k: int) -> int:
    """Code points before the end of the k-th word (from 1) that ends inside a chunk which starts in a state."""
    if state and _SPACE[data[0]]:
        k -= 1
        if not k:
            return 0
    return len(data[: int(_word_ends(data)[k - 1])].decode())


class Plan(NamedTuple):
    """How a text is cut: its tokens, its form, and the tokens before both cuts."""

    n: int
    form: str
    first: int
    second: int


def plan(doc_id: int | None, whole: Summary, empty: bool) -> Plan:
    """The draw of a text whose summary is known; a null id counts as no digits."""
    n = 0 if empty else whole.ends[0] + 1  # the last token ends with the text
    digits = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if empty or whole.marks[0] or h[2] % 100 >= PLAIN:
        return Plan(n, "plain", 0, 0)
    return Plan(n, "spm" if h[3] % 100 < SPM else "psm", *sorted((h[0] % (n + 1), h[1] % (n + 1))))


def output(text: str, form: str, first: int | None, second: int | None) -> str:
    """The text with its parts, which end at code points first and second, in the order of the form."""
    if form == "plain":
        return text
    a, b, c = text[:first], text[first:second], text[second:]
    return f"{PRE}{a}{SUF}{c}{MID}{b}" if form == "psm" else f"{SUF}{c}{PRE}{a}{MID}{b}"


def restored(out: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return out
    head, mid = out.split(MID)
    x, y = head[len(PRE) :].split(SUF if form == "psm" else PRE)
    return x + mid + y if form == "psm" else y + mid + x


KINDS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def _row(doc_id: int | None, text: str, p: Plan, cuts: list[int], keep: bool) -> tuple:
    first, second = cuts if p.form != "plain" else (None, None)
    out = output(text, p.form, first, second)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    mine = sha(out)
    return (doc_id, p.n, p.form, first, None if first is None else second - first, out if keep else None, mine, mine if p.form == "plain" else sha(restored(out, p.form)))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(KINDS), KINDS, strict=True)], schema=KINDS)


def _short(keep: bool):
    @lean
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of one chunk."""
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = []
                for doc_id, text in zip(*(b.column(c).slice(at, ROWS).to_pylist() for c in ("doc_id", "text")), strict=True):
                    data = (text or "").encode()
                    s = summary(data)
                    p = plan(doc_id, s, not data)
                    cuts = [0 if not k else len(text) if k == p.n else place(data, 0, k) for k in (p.first, p.second)]
                    rows.append(_row(doc_id, text or "", p, cuts, keep))
                yield _rows(rows)

    return done


@lean
def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk its summary, as twelve numbers."""
    for b in batches:
        flat = [[x for field in summary((t or "").encode()) for x in field] for t in b.column("chunk").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("i"), pa.array(flat, pa.list_(pa.int64()))], ["id", "i", "summary"])


def _wanted(table: pa.Table) -> pa.Table:
    """Of one text's summaries: its plan, and for each cut the chunk that holds it, the state there, and which end of a word it is there."""
    rows = sorted(table.select(["i", "summary", "doc_id"]).to_pylist(), key=lambda r: r["i"])
    parts = [Summary(tuple(r["summary"][:4]), tuple(r["summary"][4:8]), tuple(r["summary"][8:])) for r in rows]
    entry = [NOTHING]
    for s in parts:
        entry.append(entry[-1].then(s))
    p = plan(rows[0]["doc_id"], entry[-1], False)
    out = []
    for cut, k in enumerate((p.first, p.second)):
        i = next((i for i, e in enumerate(entry[1:]) if e.ends[0] >= k), None) if k else None
        whole = bool(k) and k == p.n
        out.append((table.column("id")[0].as_py(), cut, p.n, p.form, p.first, p.second, -1 if i is None or whole else i, 0 if i is None else entry[i].state[0], 0 if i is None else k - entry[i].ends[0], whole))
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "cut", "n", "form", "first", "second", "i", "state", "k", "whole"])


def _places(size: int):
    @lean
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [size * i + place(t.encode(), q, k) for i, t, q, k in zip(*(b.column(c).to_pylist() for c in ("i", "chunk", "state", "k")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cut"), pa.array(at, pa.int64())], ["id", "cut", "at"])

    return found


def _long(keep: bool):
    @lean
    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of several chunks, whose cuts are known."""
        for b in batches:
            for at in range(b.num_rows):
                doc_id, text, n, form, first, second = (b.column(c)[at].as_py() for c in ("doc_id", "text", "n", "form", "prefix", "both"))
                yield _rows([_row(doc_id, text, Plan(n, form, 0, 0), [first, second], keep)])

    return done


def infilled(docs: DataFrame, chunk: int = CHUNK, keep_output: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256 and restored_sha256 of each row.

    A null text is empty, and empty texts are plain. A null id draws as if it had no digits. Rows of one id draw alike,
    each from its own text; equal rows give equal rows. Other columns are ignored. Without keep_output, output is null.
    """
    ship(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    giant = F.char_length("text") > chunk
    shape = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in KINDS)
    short = d.where(~F.coalesce(giant, F.lit(False))).mapInArrow(_short(keep_output), shape)
    # equal rows are cut alike: one of them is scanned
    named = d.where(giant).withColumn("id", F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256)))
    chunks = named.select("id", "doc_id", F.char_length("text").alias("size"), F.posexplode(F.expr(f"transform(sequence(0, cast((char_length(text) - 1) div {chunk} as int)), i -> substring(text, i * {chunk} + 1, {chunk}))")).alias("i", "chunk"))
    chunks = saved(chunks.dropDuplicates(["id", "i"]), "chunks")
    done = chunks.select("id", "i", "chunk").mapInArrow(_summaries, "id binary, i int, summary array<long>")
    heads = chunks.where("i = 0").select("id", "doc_id", "size")
    wanted = done.join(heads, "id").groupBy("id").applyInArrow(_wanted, "id binary, cut int, n long, form string, first long, second long, i int, state int, k long, whole boolean")
    wanted = saved(wanted, "wanted")
    found = chunks.join(wanted.where("i >= 0").select("id", "cut", "i", "state", "k"), ["id", "i"]).select("id", "i", "chunk", "cut", "state", "k").mapInArrow(_places(chunk), "id binary, cut int, at long")
    cuts = wanted.join(found, ["id", "cut"], "left").join(heads.select("id", "size"), "id").withColumn("at", F.when(F.col("whole"), F.col("size")).otherwise(F.coalesce("at", F.lit(0))))
    cuts = saved(cuts.groupBy("id").agg(F.first("n").alias("n"), F.first("form").alias("form"), F.min("at").alias("prefix"), F.max("at").alias("both")), "cuts")
    long = named.join(cuts, "id").select("doc_id", "text", "n", "form", "prefix", "both").mapInArrow(_long(keep_output), shape)
    return short.unionByName(long)


def op12(docs: DataFrame) -> DataFrame:
    return infilled(docs, keep_output=False).drop("output")


_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"
OP12_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_TOKENS} AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '{PRE}') OR contains(text, '{SUF}') OR contains(text, '{MID}') OR h3 % 100 >= {PLAIN} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j FROM d),
p AS (SELECT *, array_to_string(u[1:i], '') AS a, array_to_string(u[i + 1:j], '') AS b, array_to_string(u[j + 1:n], '') AS c FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PRE}' || a || '{SUF}' || c || '{MID}' || b ELSE '{SUF}' || c || '{PRE}' || a || '{MID}' || b END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
