"""Best-fit packing by a grouping genetic algorithm.

Documents are tokenized and cut into pieces of at most SEQUENCE tokens. The rest of the problem knows
only the pieces' lengths. Pieces are dealt at random to chunks of a bounded number. Where best fit needs more bins
than a lower bound, several islands, a task each, evolve packings of the chunk, whose genes are whole bins: crossover
puts well-filled bins of one parent into the other, drops the bins that now hold a piece twice, lets the pieces that lost
their bin take the places of lesser ones where that fills a bin better, and best-fits the rest. Between epochs
each island's best packing migrates to the next island's task. Where best fit meets the bound there is nothing to search for.
Well-filled bins of a chunk's best packing are final; the pieces of its poorly filled ones migrate to the
chunks of the next round, which are fewer, until one is left.

A null or empty text is one piece, of the end id alone; repeated rows and rows of one id, null or not, are packed each for itself;
columns of other names are ignored; an empty table gives an empty one. Pieces of equal lengths go by their place in the
table of pieces, so which of them stands where may differ between runs, the number of sequences does not.
Memory is bounded by the longest text and by a chunk.
"""

from __future__ import annotations

import random
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import saved
from lodestrata.runtime import lean, ship

SEQUENCE, END = 2048, 0
#: Pieces in a chunk, on average; islands that search for a chunk's packing; packings on each; generations between migrations; times that elites migrate, and once more.
CHUNK, ISLANDS, SIZE, GENERATIONS, EPOCHS = 4096, 2, 4, 6, 2
#: A bin with at most this many free tokens is well filled.
SLACK = 8
ROUNDS = 8
#: Bytes of each of the two halves of what a task remembers; of one entry besides its word and ids.
REMEMBERED, ENTRY = 24 << 20, 150


class Remembered(dict):
    """What made says of a word, remembered in two halves: when the new one is full it becomes the old one, of which words still asked for come back."""

    def __init__(self, made: Callable[[str], bytes]):
        super().__init__()
        self.made = made
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.old: dict[str, bytes] = {}
        self.held = 0

    def __missing__(self, w: str) -> bytes:
        if self.held > REMEMBERED:
            self.old = dict(self)
            self.clear()
            self.held = 0
        out = self.old.get(w)
        if out is None:
            out = self.made(w)
        self[w] = out
        self.held += len(w) + len(out) + ENTRY
        return out


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def packed_ids(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """The ids of a text by the word_bpe_49k vocabulary, remembered by word.

    The tokenizer drops white space, lower-cases, and never merges across it, so a text's ids are those of
    its words one behind the other. That holds for texts of Latin characters without controls; all others go
    through the tokenizer whole.
    """

    PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ſ]*")
    TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªºµß-öø-ſ]+|[0-9²³¹¼½¾]|[^\\sa-z0-9²³¹¼½¾ªºµß-öø-ſ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        model = self.whole.model
        # bytes as the printable characters that stand for them in the vocabulary
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        signs = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        tokens = self.TOKEN.findall

        def made(w: str) -> bytes:
            if w.isalpha():
                return packed_ids([t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(signs))])
            if w[:-1].isalpha():  # letters are never one token with what follows them
                return self.of(w[:-1]) + self.of(w[-1])
            ids: list[int] = []
            for x in tokens(w):
                ids += [t.id for t in model.tokenize(x if x.isascii() else x.encode().decode("latin-1").translate(signs))]
            return packed_ids(ids)

        self.words = Remembered(made)
        self.of = self.words.__getitem__

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.of, text.lower().split()))
        ids = self.whole.encode(text, add_special_tokens=False).ids
        return packed_ids(ids)


_encoders: dict[str, Encoder] = {}


@lean
def _cut(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    # one vocabulary for the life of a worker, which serves many tasks
    import lodestrata.llm.packing as here

    enc = here._encoders.get(path) or here._encoders.setdefault(path, Encoder(path))
    end = struct.pack("<I", END)
    step = 4 * SEQUENCE
    for b in batches:
        out: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            ids = enc(text.as_py() or "") + end
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                for col, v in zip(out, (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
    enc.words.forget()


def pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. A null or empty text is one piece, of the end id alone."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    ship(docs.sparkSession)
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return d.mapInArrow(lambda it: _cut(it, path), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def fit(order: list[int], sizes: list[int], bins: list[list[int]]) -> list[list[int]]:
    """Best fit: each piece of order goes into the fullest bin that has room, or a new one. bins are extended in place."""
    room = sorted((SEQUENCE - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, k = room.pop(at)
            bins[k].append(i)
        else:
            free, k = SEQUENCE, len(bins)
            bins.append([i])
        if free > sizes[i]:
            insort(room, (free - sizes[i], k))
    return bins


def least_bins(sizes: list[int]) -> int:
    """A bound from below: by the sum, and with pieces over half a sequence alone or beside those that fit them."""
    total = sum(sizes)
    best = -(-total // SEQUENCE)
    for cut in sorted({s for s in sizes if 2 * s <= SEQUENCE})[:: max(1, len(sizes) // 64)]:
        big = [s for s in sizes if s > SEQUENCE - cut]
        mid = [s for s in sizes if SEQUENCE // 2 < s <= SEQUENCE - cut]
        small = sum(s for s in sizes if cut <= s <= SEQUENCE // 2)
        best = max(best, len(big) + len(mid) + max(0, -(-(small - (len(mid) * SEQUENCE - sum(mid))) // SEQUENCE)))
    return best


def _worth(bins: list[list[int]], sizes: list[int]) -> float:
    """Fewer bins, then more uneven fills: a packing with one nearly empty bin is nearest to losing it."""
    return -len(bins) + sum((sum(sizes[i] for i in b) / SEQUENCE) ** 2 for b in bins) / len(bins)


def _filled(bins: list[list[int]], loose: list[int], sizes: list[int]) -> list[int]:
    """Loose pieces take the places of one or two lesser pieces of a bin where that leaves less of it free; the loose ones after that, longest first."""
    left = sorted((sizes[i], i) for i in loose)
    for b in bins:
        while True:
            free, best = SEQUENCE - sum(sizes[i] for i in b), None
            if not free or not left:
                break
            out = [(sizes[i], (i,)) for i in b] + [(sizes[i] + sizes[j], (i, j)) for k, i in enumerate(b) for j in b[k + 1 :]]
            for size, gone in out:
                at = bisect_right(left, (size + free, len(sizes))) - 1
                if at >= 0 and left[at][0] > size and (best is None or left[at][0] - size > best[0]):
                    best = (left[at][0] - size, at, gone)
            if best is None:
                break
            _, at, gone = best
            new = left.pop(at)[1]
            b[:] = [i for i in b if i not in gone] + [new]
            for i in gone:
                insort(left, (sizes[i], i))
    return [i for _, i in reversed(left)]


def _crossed(a: list[list[int]], b: list[list[int]], sizes: list[int], rng: random.Random) -> list[list[int]]:
    """a with some whole well-filled bins of b put in; a's bins with a piece of those go, and their other pieces are best-fitted."""
    full = sorted(b, key=lambda x: -sum(sizes[i] for i in x))[: max(2, len(b) // 2)]
    put = rng.sample(full, max(1, len(full) // 3))
    there = {i for x in put for i in x}
    keep, loose = [list(x) for x in put], []
    for x in a:
        if there.isdisjoint(x):
            keep.append(list(x))
        else:
            loose += [i for i in x if i not in there]
    return fit(_filled(keep, loose, sizes), sizes, keep)


def _changed(a: list[list[int]], sizes: list[int], rng: random.Random) -> list[list[int]]:
    """a with its emptiest bin and a few others taken apart and best-fitted."""
    by = sorted(range(len(a)), key=lambda k: sum(sizes[i] for i in a[k]))
    gone = {by[0], *rng.sample(by, min(len(by), 4))}
    loose = [i for k in gone for i in a[k]]
    keep = [list(x) for k, x in enumerate(a) if k not in gone]
    return fit(_filled(keep, loose, sizes), sizes, keep)


def first_population(sizes: list[int], seed: int) -> list[list[list[int]]]:
    """Best fit by decreasing lengths, and by orders near to that; the best comes first."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    own = [fit(order, sizes, [])]
    while len(own) < SIZE:
        own.append(fit(sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.9, 1)), sizes, []))
    return sorted(own, key=lambda x: -_worth(x, sizes))


def epoch(own: list[list[list[int]]], elite: list[list[int]] | None, sizes: list[int], bound: int, seed: int) -> list[list[list[int]]]:
    """A population after GENERATIONS; the elite of another island takes the place of its worst packing."""
    rng = random.Random(seed)
    if elite is not None:
        own = sorted([*own[:-1], elite], key=lambda x: -_worth(x, sizes))
    for _ in range(GENERATIONS):
        if len(own[0]) <= bound:
            break
        a, b = rng.sample(own, 2)
        child = _crossed(a, b, sizes, rng)
        if rng.random() < 0.5:
            child = _changed(child, sizes, rng)
        own = sorted([*own, child], key=lambda x: -_worth(x, sizes))[:SIZE]
    return own


def evolve(sizes: list[int], seed: int) -> list[list[int]]:
    """A packing of the pieces 0..n-1, as lists of pieces, by islands in one process; packed() runs the same epochs in a task for each island."""
    bound = least_bins(sizes)
    islands = [first_population(sizes, seed * ISLANDS + k) for k in range(ISLANDS)]
    for e in range(EPOCHS):
        if min(len(x[0]) for x in islands) <= bound:
            break
        elites = [x[0] for x in islands]
        islands = [epoch(x, elites[k - 1] if e else None, sizes, bound, (seed * ISLANDS + k) * EPOCHS + e) for k, x in enumerate(islands)]
    return max((x[0] for x in islands), key=lambda x: _worth(x, sizes))


STATE = "chunk long, island int, rids binary, sizes binary, packings array<binary>, bound int, n int, worth double"
_STATE = ["chunk", "island", "rids", "sizes", "packings", "bound", "n", "worth"]
_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.int32(), pa.float64()]


def _numbered(bins: list[list[int]], n: int) -> bytes:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(raw: bytes) -> list[list[int]]:
    of = np.frombuffer(raw, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def _states(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(_KINDS), _KINDS, strict=True)], _STATE)


def _row(chunk: int, island: int, rids: bytes, sizes: list[int], own: list[list[list[int]]], bound: int) -> tuple:
    return chunk, island, rids, np.array(sizes, np.int32).tobytes(), [_numbered(x, len(sizes)) for x in own], bound, len(own[0]), _worth(own[0], sizes)


def _seeded(table: pa.Table) -> pa.Table:
    """A chunk's first populations, one for each island; where best fit needs no bin more than the bound, nothing is left to search for and one packing is all."""
    order = np.argsort(table.column("rid").to_numpy())  # as they come is not the same on a rerun
    rids, sizes, chunk = table.column("rid").to_numpy()[order], table.column("length").to_numpy()[order].tolist(), table.column("chunk")[0].as_py()
    bound = least_bins(sizes)
    best = fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, [])
    if len(best) <= bound:
        return pa.Table.from_batches([_states([_row(chunk, 0, rids.tobytes(), sizes, [best], bound)])])
    return pa.Table.from_batches([_states([_row(chunk, k, rids.tobytes(), sizes, first_population(sizes, chunk * ISLANDS + k), bound) for k in range(ISLANDS)])])


@lean
def _epochs(batches: Iterator[pa.RecordBatch], e: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
            sizes = np.frombuffer(r["sizes"], np.int32).tolist()
            own = epoch([_bins(x) for x in r["packings"]], _bins(r["elite"]) if r["elite"] else None, sizes, r["bound"], (r["chunk"] * ISLANDS + r["island"]) * EPOCHS + e)
            yield _states([_row(r["chunk"], r["island"], r["rids"], sizes, own, r["bound"])])


@lean
def _placed(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Every piece's bin and place. Well-filled bins are done; the emptiest bin never is, but in the last round."""
    for b in batches:
        for r in (x for i in range(b.num_rows) for x in b.slice(i, 1).to_pylist()):
            rids, sizes, of = np.frombuffer(r["rids"], np.int64), np.frombuffer(r["sizes"], np.int32).astype(np.int64), np.frombuffer(r["packing"], np.int32)
            order = np.argsort(of, kind="stable")
            rids, sizes, of = rids[order], sizes[order], of[order]
            fill = np.bincount(of, weights=sizes).astype(np.int64)
            before = np.cumsum(sizes) - sizes
            offset = before - before[np.searchsorted(of, of)]
            done = np.full(len(of), last) | ((fill[of] >= SEQUENCE - SLACK) & (of != np.argmin(fill)))
            yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(sizes), pa.array(np.full(len(of), r["chunk"])), pa.array(of.astype(np.int64)), pa.array(offset), pa.array(done)], ["rid", "length", "chunk", "bin", "offset", "done"])


def _searched(dealt: DataFrame) -> DataFrame:
    """(chunk, rids, sizes, packing): the best packing found of each chunk of (rid, length, chunk). Between epochs each island's elite goes to the next island's task."""
    state = saved(dealt.groupBy("chunk").applyInArrow(_seeded, STATE), "islands")
    over = F.min("n").over(Window.partitionBy("chunk")) <= F.col("bound")
    for e in range(EPOCHS):
        state = state.withColumn("over", over)
        live = state.where("not over").drop("over")
        if live.limit(1).count() == 0:
            state = state.drop("over")
            break
        elite = live.select("chunk", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), (F.get("packings", F.lit(0)) if e else F.lit(None).cast("binary")).alias("elite"))
        moved = live.join(elite, ["chunk", "island"]).mapInArrow(lambda it, e=e: _epochs(it, e), STATE)
        state = saved(state.where("over").drop("over").unionByName(moved), "islands")
    best = state.groupBy("chunk").agg(F.max(F.struct("worth", (-F.col("island")).alias("island"))).alias("m"))
    best = best.select("chunk", (-F.col("m.island")).alias("island"))
    return state.join(best, ["chunk", "island"]).select("chunk", "rids", "sizes", F.get("packings", F.lit(0)).alias("packing"))


def packed(cut: DataFrame) -> DataFrame:
    """pieces with sequence_id and offset added."""
    schema = "rid long, length long, chunk long, bin long, offset long, done boolean"
    ship(cut.sparkSession)
    cut = saved(cut.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") >= SEQUENCE).select("rid", F.col("rid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = cut.where(F.col("length") < SEQUENCE).select("rid", "length")
    found, n = [full], left.count()
    was = None
    for k in range(ROUNDS):
        chunks = max(1, -(-n // CHUNK))
        last = chunks == 1 or k == ROUNDS - 1 or (was is not None and n > 0.9 * was)
        dealt = left.withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(k)), F.lit(chunks)))
        done = saved(_searched(dealt).mapInArrow(lambda it, last=last: _placed(it, last), schema), "bins")
        # the highest bit, the round, the chunk and the bin make a number that no other sequence has
        code = F.lit(1 << 62) + F.lit(k).cast("long") * (1 << 58) + F.col("chunk") * (1 << 16) + F.col("bin")
        found.append(done.where("done").select("rid", code.alias("sequence_id"), "offset"))
        if last:
            break
        left, was = done.where("not done").select("rid", "length"), n
        n = left.count()
        if not n:
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return cut.join(every, "rid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10(docs: DataFrame) -> DataFrame:
    return packed(pieces(docs))
