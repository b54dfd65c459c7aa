"""Language identification by Bayesian evidence fusion.

Four kinds of evidence on a document's language are added as logarithms:

- its text: a naive Bayes model over hashed byte trigrams, fitted on a bounded sample of rows whose
  language is known, and tempered, because trigrams are not independent;
- the language that its markup or metadata declares, through how often documents of each language declare
  each language;
- the suffix of its address, in the same way;
- its host: a prior over languages, smoothed towards that of the host's domain, that towards the suffix's,
  and that towards the whole corpus's.

The last three are grouped aggregations over all documents of what their texts alone say, so that no
document's own declaration is taken as truth. The evidence tables hold a row per value and level; they
are joined, not broadcast, and hot values are summed before they are shuffled and looked up in salted parts.

Without letters a document has no text evidence. A document is rejected if it has none, or if no target
language reaches LEAST of the posterior. Null text: no evidence, rejected. Null declarations, addresses and
hosts: no evidence of that kind. Rows are judged one by one; repeated rows give repeated rows. Languages of equal
probability: the first by name. Columns of any name are ignored, an empty table gives an empty one, and a long text is
read whole, in parts cut at blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm import htmlmain
from lodestrata.llm.common import saved
from lodestrata.llm.shingles import encoded
from lodestrata.runtime import lean, ship

#: Labelled rows that the text model is fitted on, at most (one of each language at least): of each language those of the smallest hashes of their ids.
SAMPLE = 1500
#: Tasks that count the sample's trigrams.
FIT_TASKS = 8
#: Buckets of trigram hashes; weight of a text's evidence for each trigram; trigrams whose worth of evidence a text has at most, as neighbouring ones repeat each other.
BITS, TEMPER, MOST = 14, 0.35, 60.0
#: Documents' worth of the level above that a host, domain or suffix starts with; and of evenness in declarations.
STRENGTH, EVEN = 10.0, 2.0
LEAST = 0.5
#: Parts into which the rows of a value are dealt when they look it up.
SALTS = 8
#: Bytes hashed at once.
SLICE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What is no letter counts as one blank; bytes of other scripts and accents count as letters.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, bucket) of every trigram with a letter in each of texts."""
    buf = b"  ".join([b"", *texts, b""])
    b = _LOWER[np.frombuffer(buf, np.uint8)]
    letter = _LETTER[b]
    b = np.where(letter, b, np.uint8(32)).astype(np.uint32)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    bucket = (h >> np.uint32(32 - BITS)).astype(np.intp)
    # a trigram belongs to the text in which its middle byte stands; the blanks between texts keep them apart
    own = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 2 for t in texts])
    good = letter[1:-1]
    return own[good], bucket[good]


def _parts(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, texts) in parts of about SLICE bytes; a longer text is cut, and its parts bear its place."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > SLICE:
            at = 0
            while at < len(texts[i]):  # cut where no trigram is lost: each part begins at the last cut's blank, if there is one
                end = at + SLICE
                end = max(texts[i].rfind(b" ", at + 1, end), texts[i].rfind(b"\n", at + 1, end)) if end < len(texts[i]) else len(texts[i])
                end = end if end > at else at + SLICE
                yield i, [texts[i][at:end]]
                at = end
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and size + len(texts[j]) <= SLICE:
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """How often each bucket occurs in texts."""
    out = np.zeros(1 << BITS)
    for _, part in _parts(texts):
        out += np.bincount(trigrams(part)[1], minlength=1 << BITS)
    return out


class TextModel:
    """log P(trigram | language), fitted by counting, smoothed by one half."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        n = np.array([counts[x] for x in self.langs]) + 0.5
        self.table = np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
        self.table -= self.table.max(0)  # only differences between languages count

    def scores(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(tempered log likelihoods, one row per text; number of trigrams)."""
        total, n = np.zeros((len(raw), len(self.langs))), np.zeros(len(raw), np.int64)
        for at, part in _parts(raw):
            own, bucket = trigrams(part)
            for k in range(len(self.langs)):
                total[at : at + len(part), k] += np.bincount(own, self.table[k][bucket], len(part))
            n[at : at + len(part)] += np.bincount(own, minlength=len(part))
        total -= total.max(1, keepdims=True)
        scale = TEMPER * np.minimum(1.0, MOST / np.maximum(n, 1))
        return total * scale[:, None], n


@lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, the counts of the task's texts."""
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        at = 0
        for raw in encoded(b.column("text")):
            langs = b.column("l").slice(at, len(raw)).to_pylist()
            at += len(raw)
            for lang in set(langs):
                sums[lang] = sums.get(lang, 0) + gram_counts([t for t, x in zip(raw, langs, strict=True) if x == lang])
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([c.tobytes() for c in sums.values()], pa.binary())], ["l", "counts"])


def sampled(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """(l, h, text) of at most `sample` rows, an equal share of each language's and one at least: those whose ids and texts hash lowest; equal rows count once."""
    t = F.col(text).cast("string")
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(t.alias("text"), F.col(lang).cast("string").alias("l"), F.xxhash64(F.col("doc_id").cast("string"), t).alias("h"))
    counts = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    if not counts:
        return rows.limit(0)
    each = max(1, sample // len(counts))
    # the window sees about twice as many hashes of a language as it keeps, and at least ten more, so that they seldom leave it fewer
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, (2 * each + 10) / n) * (1 << 40)) + 1)])
    few = rows.where(F.pmod("h", F.lit(1 << 40)) < F.element_at(share, F.col("l")))
    last = few.select("l", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("n") <= each)
    cuts = last.groupBy("l").agg(F.max("h").alias("cut")).collect()  # one for each language
    upto = F.create_map(*[F.lit(x) for r in cuts for x in (r.l, r.cut)])
    return few.where(F.col("h") <= F.element_at(upto, F.col("l"))).dropDuplicates(["l", "h"])


def fitted(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> TextModel:
    """The text model of the sampled rows' whole texts. Their trigrams are counted where they are; the driver adds up arrays of 2^BITS numbers, one for each task and language."""
    ship(labelled.sparkSession)
    rows = sampled(labelled, text, lang, sample)
    sums: dict[str, np.ndarray] = {}
    for r in rows.select("l", "text").coalesce(FIT_TASKS).mapInArrow(_counted, "l string, counts binary").toLocalIterator():
        sums[r.l] = sums.get(r.l, 0) + np.frombuffer(r.counts)
    return TextModel(sums or {"und": np.zeros(1 << BITS)})


@lean
def _scored(batches: Iterator[pa.RecordBatch], model: TextModel, names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for raw in encoded(b.column("_text")):
            s, n = model.scores(raw)
            cols = [b.column(x).slice(at, len(raw)) for x in names]
            at += len(raw)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(s), pa.list_(pa.float64())), pa.array(n, pa.int64())], [*names, "text_log", "n_grams"])


def _sums(k: int, name: str = "p") -> list[Column]:
    return [F.sum(F.col(name)[i]).alias(f"s{i}") for i in range(k)]


def identify(docs: DataFrame, model: TextModel, text: str = "text", host: Column | None = None, declared: Column | None = None, suffix: Column | None = None, domain: Column | None = None, keep: tuple[str, ...] = ("doc_id",), least: float = LEAST, targets: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of keep, with lang_found (null if rejected for want of evidence), probability, n_grams and kept."""
    spark: SparkSession = ship(docs.sparkSession)
    langs = model.langs
    k = len(langs)
    null = F.lit(None).cast("string")
    named = {"_host": host, "_domain": domain, "_suffix": suffix, "_declared": declared}
    d = docs.select(*keep, F.col(text).cast("string").alias("_text"), *[(c if c is not None else null).cast("string").alias(n) for n, c in named.items()])
    names = [*keep, *named]
    shared = spark.sparkContext.broadcast(model)  # 2^BITS numbers for each language
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema if f.name != "_text") + ", text_log array<double>, n_grams long"
    s = d.mapInArrow(lambda it: _scored(it, shared.value, names), schema)
    top = F.array_max("text_log")
    e = F.transform("text_log", lambda x: F.exp(x - top))
    s = s.withColumn("_e", e).withColumn("p", F.when(F.col("n_grams") > 0, F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y)))).drop("_e")
    s = saved(s, "scored")
    said = s.where("p is not null")
    # sums by every combination that occurs, once; the levels are then sums of these
    cells = saved(said.groupBy(*named).agg(F.count("*").alias("n"), *_sums(k)), "cells")
    add = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    whole = cells.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k)]).first()
    total = sum(whole) or 1.0
    prior = [(w + EVEN) / (total + k * EVEN) for w in whole]
    level = F.array(*[F.lit(p) for p in prior])

    def smoothed(by: str, above: DataFrame | None, key: str | None) -> DataFrame:
        """P(language) of each value, from its own sums and STRENGTH documents of the level above."""
        g = cells.where(F.col(by).isNotNull()).groupBy(by, *([key] if key else [])).agg(*add)
        if above is not None:
            g = g.join(above.withColumnRenamed("prior", "_up"), key, "left").withColumn("_up", F.coalesce("_up", level))
        else:
            g = g.withColumn("_up", level)
        n = sum((F.col(f"s{i}") for i in range(k)), F.lit(0.0))
        p = F.array(*[(F.col(f"s{i}") + STRENGTH * F.col("_up")[i]) / (n + STRENGTH) for i in range(k)])
        return g.select(by, *([key] if key else []), p.alias("prior"))

    priors: list[tuple[list[str], DataFrame]] = []
    up, key = None, None
    for by, c in (("_suffix", suffix), ("_domain", domain), ("_host", host)):
        if c is not None:
            up = smoothed(by, up, key)
            # a host belongs to one domain, a domain to one suffix; where data says otherwise each pair is a value
            priors = [([by, *([key] if key else [])], up)]
            if key:
                up = up.drop(key).groupBy(by).agg(F.array(*[F.avg(F.col("prior")[i]) for i in range(k)]).alias("prior"))
            key = by

    def channel(by: str) -> DataFrame:
        """P(value | language) for each value: how documents of a language declare, or are addressed."""
        g = cells.where(F.col(by).isNotNull()).groupBy(by).agg(*add)
        of = cells.where(F.col(by).isNotNull()).agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0.0)) for i in range(k)], F.count_distinct(by)).first()
        v = max(1, of[k])
        return g.select(by, F.array(*[F.log((F.col(f"s{i}") + EVEN / v) / F.lit(of[i] + EVEN)) for i in range(k)]).alias("_said"))

    out = s.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    salted = lambda t: t.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    log = F.col("text_log")
    for on, table in priors:
        out = out.join(salted(table), [*on, "_salt"], "left")
    out = out.withColumn("_prior", F.coalesce("prior", level) if priors else level)
    log = F.transform(log, lambda x, i: x + F.log(F.get("_prior", i)))
    out = out.withColumn("_log", log)
    for by, c in (("_declared", declared), ("_suffix", suffix)):
        if c is not None:
            out = out.join(salted(channel(by)), [by, "_salt"], "left")
            out = out.withColumn("_log", F.when(F.col("_said").isNotNull(), F.zip_with("_log", "_said", lambda x, y: x + y)).otherwise(F.col("_log"))).drop("_said")
    high = F.array_max("_log")
    out = out.withColumn("_w", F.transform("_log", lambda x: F.exp(x - high)))
    out = out.withColumn("probability", F.lit(1.0) / F.aggregate("_w", F.lit(0.0), lambda a, x: a + x))
    # ties go to the language first by name
    found = F.get(F.array(*[F.lit(x) for x in langs]), (F.array_position("_w", F.array_max("_w")) - 1).cast("int"))
    out = out.withColumn("lang_found", F.when(F.col("n_grams") > 0, found))
    wanted = F.col("lang_found").isin(*targets) if targets else F.col("lang_found").isNotNull()
    out = out.withColumn("kept", F.coalesce(wanted & (F.col("probability") >= least), F.lit(False)))
    return out.select(*keep, "lang_found", "probability", "n_grams", "kept")


def address_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, domain, suffix) of an address; null where it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    return host, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"\.([^.]+)$", 1)


def declared_in(html: Column) -> Column:
    """The language that a page's html element declares, without its region; null if it declares none."""
    lang = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    return F.when(lang != "", lang)


def op3(docs: DataFrame) -> DataFrame:
    """Documents bear their source in place of a host and a declared language; they have no address."""
    model = fitted(docs)
    return identify(docs, model, host=F.col("source"), declared=F.col("lang"))


@lean
def _page_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [htmlmain.main_text(x) for x in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("declared"), pa.array(texts, pa.string())], ["page_id", "url", "declared", "text"])


def op3_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Pages by their main text, the language that their markup declares, and the suffix, domain and host of their address."""
    ship(pages.sparkSession)
    p = pages.select("page_id", "url", declared_in(F.col("html")).alias("declared"), "html")
    kinds = dict(p.dtypes)
    p = p.mapInArrow(_page_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, declared string, text string")
    host, domain, suffix = address_parts(F.col("url"))
    return identify(p, model, host=host, domain=domain, suffix=suffix, declared=F.col("declared"), keep=("page_id",))
