"""Structural search: patterns of code with holes, matched over trees of balanced brackets.

An inverted index (word, path) tells which files hold all words of a pattern; only their contents are read. In each of
these a small matcher goes through the bracket groups. A hole `$A` takes a run of one node or more on one level without
a separating comma or semicolon, `$$$` and `$$$A` any run, also an empty one; equal names take equal tokens. Runs are
tried short first, hole by hole, so the first match of a place is well defined. Comments and white space count for nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.runtime import ship

#: Endings of files whose comments begin with a hash.
HASH_ENDINGS = ("py", "rb", "sh", "bash", "pl", "pm", "r", "ex", "exs", "yaml", "yml", "toml")
_STRINGS = r'"""[\s\S]*?(?:"""|$)|\'\'\'[\s\S]*?(?:\'\'\'|$)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?|`(?:\\[\s\S]|[^`\\])*`?'
_REST = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|=>|->|::|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|\?\.|\.\.\.|[-+*/%&|^]=|\S"
_SLASHES = re.compile(rf"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|$))|{_STRINGS}|{_REST}")
_HASHES = re.compile(rf"(?P<comment>#[^\n]*)|{_STRINGS}|{_REST}")
_HOLE = re.compile(r"\$\$\$[A-Z_][A-Z0-9_]*|\$\$\$|\$[A-Z_][A-Z0-9_]*")
_WORD = r"[A-Za-z_$][A-Za-z0-9_$]*"
_CLOSES = {"(": ")", "[": "]", "{": "}"}


class Node(NamedTuple):
    """A token, or a bracket group: its text is the opening bracket then. start and end are places in the source."""

    text: str
    start: int
    end: int
    inner: tuple[Node, ...] | None = None


def tree(source: str, hashes: bool = False, pattern: bool = False) -> tuple[Node, ...]:
    """The nodes of a source. A closing bracket that closes nothing is a token; what is left open ends with the source."""
    lexer = _HASHES if hashes else _SLASHES
    stack: list[tuple[str, int, list[Node]]] = [("", 0, [])]
    at = 0
    while True:
        m = _HOLE.match(source, at) if pattern and source.startswith("$", at) else None
        m = m or lexer.search(source, at)
        if not m:
            break
        if pattern and m.re is not _HOLE and (h := source.find("$", at, m.start() + 1)) >= 0 and (hole := _HOLE.match(source, h)):
            m = hole
        at = m.end()
        if m.re is not _HOLE and m["comment"] is not None:
            continue
        t = m[0]
        if t in _CLOSES:
            stack.append((t, m.start(), []))
        elif t in (")", "]", "}") and any(_CLOSES.get(s[0]) == t for s in stack):
            while True:
                opened, start, inner = stack.pop()
                stack[-1][2].append(Node(opened, start, m.end() if _CLOSES[opened] == t else m.start(), tuple(inner)))
                if _CLOSES[opened] == t:
                    break
        else:
            stack[-1][2].append(Node(t, m.start(), m.end()))
    while len(stack) > 1:
        opened, start, inner = stack.pop()
        stack[-1][2].append(Node(opened, start, len(source), tuple(inner)))
    return tuple(stack[0][2])


def _same(a: tuple[Node, ...], b: tuple[Node, ...]) -> bool:
    return len(a) == len(b) and all(x.text == y.text and (x.inner is None) == (y.inner is None) and (x.inner is None or _same(x.inner, y.inner)) for x, y in zip(a, b, strict=True))


def _matches(pattern: tuple[Node, ...], nodes: tuple[Node, ...], at: int, bound: dict, whole: bool) -> Iterator[tuple[int, dict]]:
    """(end, bindings) of the ways in which a pattern takes nodes from a place on; with whole, all of them."""
    if not pattern:
        if not whole or at == len(nodes):
            yield at, bound
        return
    head, rest = pattern[0], pattern[1:]
    if head.text.startswith("$") and head.inner is None and _HOLE.fullmatch(head.text):
        any_run = head.text.startswith("$$$")
        name = head.text.lstrip("$")
        if name in bound:
            run = nodes[at : at + len(bound[name])]
            if _same(run, bound[name]):
                yield from _matches(rest, nodes, at + len(run), bound, whole)
            return
        end = at if any_run else at + 1
        while end <= len(nodes) and (any_run or nodes[end - 1].text not in (",", ";") or nodes[end - 1].inner is not None):
            yield from _matches(rest, nodes, end, {**bound, name: nodes[at:end]} if name else bound, whole)
            if not rest and whole and end < len(nodes):
                end = len(nodes) - 1 if any_run else end  # the last hole of a whole level takes all that is left
            end += 1
        return
    if at >= len(nodes) or head.text != nodes[at].text or (head.inner is None) != (nodes[at].inner is None):
        return
    if head.inner is None:
        yield from _matches(rest, nodes, at + 1, bound, whole)
        return
    for _, inside in _matches(head.inner, nodes[at].inner, 0, bound, True):
        yield from _matches(rest, nodes, at + 1, inside, whole)


def found(pattern: tuple[Node, ...], nodes: tuple[Node, ...]) -> Iterator[tuple[int, int, dict]]:
    """(start, end, bindings) of the first match at each place of each level, in the order of the source."""
    for at, node in enumerate(nodes):
        for end, bound in _matches(pattern, nodes, at, {}, False):
            if end > at:
                yield node.start, nodes[end - 1].end, bound
                break
        if node.inner is not None:
            yield from found(pattern, node.inner)


def word_index(files: DataFrame) -> DataFrame:
    """(word, path): every word of every file (path, content) once. Written as a table sorted by word, a search reads only the words it asks for."""
    return files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(f"({_WORD})"), 1))).alias("word")).select("word", "path")


def literal_words(pattern: str) -> list[str]:
    """The words that a file must hold to match a pattern."""

    def words(nodes: tuple[Node, ...]) -> set[str]:
        return set().union(*[words(n.inner) if n.inner is not None else {n.text} if re.fullmatch(_WORD, n.text) and not _HOLE.fullmatch(n.text) else set() for n in nodes])

    return sorted(words(tree(pattern, pattern=True)))


def candidates(index: DataFrame, pattern: str) -> DataFrame | None:
    """The paths of the files that hold all words of a pattern; None if it has no word, so any file may match."""
    words = literal_words(pattern)
    if not words:
        return None
    return index.where(F.col("word").isin(words)).groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") == len(words)).select("path")


SHAPE = "path string, line long, end_line long, text string, bindings map<string,string>"


def _searched(pattern: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {h: tree(pattern, h, True) for h in (True, False)}
        for b in batches:
            out = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                c = content or ""
                hashes = path.rpartition(".")[2].lower() in HASH_ENDINGS
                for start, end, bound in found(wanted[hashes], tree(c, hashes)):
                    line = c.count("\n", 0, start) + 1
                    out.append((path, line, line + c.count("\n", start, end), c[start:end], [(k, c[v[0].start : v[-1].end] if v else "") for k, v in bound.items()]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], ["path", "line", "end_line", "text", "bindings"])

    return rows


def structural_search(files: DataFrame, index: DataFrame, pattern: str, extension: str | Column | None = None) -> DataFrame:
    """path, line, end_line, text and bindings of the places in files (path, content) that match a pattern, by an index of their words."""
    if not tree(pattern, pattern=True):
        raise ValueError("a pattern needs a token")
    ship(files.sparkSession)
    d = files.select("path", F.col("content").cast("string").alias("content"))
    if extension is not None:
        d = d.where(F.col("path").endswith(extension))
    few = candidates(index, pattern)
    return (d if few is None else d.join(few, "path", "left_semi")).mapInArrow(_searched(pattern), SHAPE)
