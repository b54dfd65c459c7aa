"""The corpus operators on small tables: against brute force, and on nulls, empty texts, ties, repeated rows and clashing columns."""

import collections
import gzip
import hashlib
import math
import os
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import fingerprint, htmlmain, langid, mixing, ngramjoin, packing, paragraphs, pii, pii_model, quality, shingles, warc
from lodestrata.llm.common import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LONG = "word " * 30_000
TEXTS = [(1, "The one and the other went to the house of the man", "en", "a"), (2, None, "fr", "b"), (3, "", None, None), (4, " \n\t ", "en", "a"), (5, LONG, "en", "a"), (6, "le la les de la maison et le jardin", "fr", "b"), (6, "le la les de la maison et le jardin", "fr", "b"), (None, "a b c d e f g h i j k", "en", None)]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns of the names that the operators use inside."""
    d = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    return d.withColumns({c: F.lit("x") for c in ("t", "w", "n", "key", "_t", "part", "spans", "size", "block", "start", "times")})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_quality_counts(docs, none):
    rows = quality.op1(docs).collect()
    assert len(rows) == len(TEXTS) and quality.op1(none).count() == 0
    for r in rows:
        for _, text, *_ in [t for t in TEXTS if t[0] == r.doc_id][:1]:
            w = WORD.findall(text or "")
            grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
            n = collections.Counter(grams)
            repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
            assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(repeated))
            assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w))
            assert not (r.base_failed and r.kept)


def test_quality_ablations(docs):
    led = quality.ledger(docs)
    rows = {r.rule: r for r in quality.ablations(led, quality.BASE).collect()}
    bits = [r.failed & quality.BASE.mask for r in led.collect()]
    assert rows["few_words"].n_failed == sum(b & 1 for b in bits)
    assert rows["few_words"].n_only == sum(b == 1 for b in bits)
    assert rows["few_words"].n_kept_without == sum(b in (0, 1) for b in bits)


EMAIL, IP, CARD, PHONE = (re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _base(t):
    def luhn(d):
        return sum((v * 2 - 9 if v * 2 > 9 else v * 2) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for kind, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (13 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark, docs, none):
    rng = random.Random(3)
    texts = ["a@b.com_x@y.z", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "+1 (555) 010-9999 +49.30.1234567..", "4111 1111 1111 1111 4111-1111-1111-1112", "é 😀 a@b.co 😀 10.0.0.1", "1" * 20_000, "1.1.1.1 " * 200, "a@" * 2000, None, ""]
    texts += ["".join(rng.choice("ab1.2@+ -()3\n0é") for _ in range(rng.randint(0, 90))) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.op2(d).collect():
        base = _base(texts[r.doc_id] or "")
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
        assert [sum(b.startswith(k) for b in base) for k in pii.BASE] == [r.n_email, r.n_ip, r.n_card, r.n_phone]
        assert r.spans.startswith(",".join(base))
    assert pii.op2(docs).count() == len(TEXTS) and pii.op2(none).count() == 0


def test_pii_redaction(spark):
    d = spark.createDataFrame([(1, 'x a@b.com, 10.0.0.1; token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce".', 7), (2, None, 8), (3, "clean words only", 9)], "doc_id long, text string, start long")
    rows = {r.doc_id: r for r in pii.redact(d).collect()}
    assert rows[1].text == 'x [EMAIL], [IP]; token = "[SECRET]".'
    assert rows[2].text is None and rows[3].text == "clean words only" and rows[1].start == 7


def test_pii_trees_hold_out():
    trees, cuts = pii_model.fitted()
    held = pii_model._examples(random.Random(99), 300)
    for k, kind in enumerate(pii_model.KINDS):
        said = [(pii_model.margin(trees, f) > cuts[k], good) for f, good in held if f[0] == k]
        assert sum(a and b for a, b in said) >= 0.93 * sum(a for a, _ in said), kind
        assert sum(a and b for a, b in said) >= 0.6 * sum(b for _, b in said), kind


def _model(**texts):
    return langid.TextModel({k: langid.gram_counts([t.encode()]) for k, t in texts.items()})


def _grams(text):
    """Buckets of a text's trigrams with a letter, one by one."""
    b = [c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()]
    b = [32, 32, *[c if 97 <= c <= 122 or c >= 128 else 32 for c in b], 32, 32]
    return [((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - langid.BITS for i in range(1, len(b) - 1) if b[i] != 32]


def _fused(rows, model):
    """(language, probability) of rows (text, host, declared), by the formulas, in plain Python."""
    k, logs, ps = len(model.langs), [], []
    for text, *_ in rows:
        g = _grams(text)
        s = [sum(float(model.table[i][x]) for x in g) for i in range(k)]
        scale = langid.TEMPER * min(1.0, langid.MOST / max(len(g), 1))
        s = [(v - max(s)) * scale for v in s]
        logs.append(s)
        e = [math.exp(v) for v in s]
        ps.append([v / sum(e) for v in e] if g else None)
    add = lambda of: [sum(p[i] for p, r in zip(ps, rows, strict=True) if p and of(r)) for i in range(k)]
    whole = add(lambda r: True)
    level = [(w + langid.EVEN) / (sum(whole) + k * langid.EVEN) for w in whole]
    said = add(lambda r: r[2] is not None)
    values = len({r[2] for r, p in zip(rows, ps, strict=True) if p and r[2] is not None})
    out = []
    for (_, host, declared), s, p in zip(rows, logs, ps, strict=True):
        h = add(lambda r: r[1] == host) if host is not None else [0] * k
        prior = [(v + langid.STRENGTH * u) / (sum(h) + langid.STRENGTH) for v, u in zip(h, level, strict=True)] if host is not None else level
        x = [v + math.log(q) for v, q in zip(s, prior, strict=True)]
        if declared is not None:
            d = add(lambda r: r[2] == declared)
            x = [v + math.log((d[i] + langid.EVEN / values) / (said[i] + langid.EVEN)) for i, v in enumerate(x)]
        e = [math.exp(v - max(x)) for v in x]
        best = max(range(k), key=lambda i: (e[i], -i))
        out.append((model.langs[best] if p else None, e[best] / sum(e)))
    return out


def test_language_against_plain_python(spark):
    rng = random.Random(8)
    model = _model(de="der die das und ist nicht ein haus " * 3, en="the man and the house of the other one " * 3, fr="le jardin de la maison et les enfants " * 3)
    words = "der die und nicht haus the man house other le jardin maison enfants 12 !! Ärger ça".split()
    rows = [(" ".join(rng.choice(words[3 * (i % 5) :]) for _ in range(rng.randint(0, 30))) if i % 11 else None, rng.choice(["h1", "h2", None]), rng.choice(["de", "en", "fr", None])) for i in range(120)]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, host string, said string")
    got = {r.doc_id: r for r in langid.identify(d, model, host=F.col("host"), declared=F.col("said")).collect()}
    for i, (lang, p) in enumerate(_fused(rows, model)):
        assert got[i].lang_found == lang and (lang is None or abs(got[i].probability - p) < 1e-6)
        assert got[i].kept == (lang is not None and p >= langid.LEAST)


def test_sample_reads_whole_texts(spark):
    text = "abc " * 5000 + "xyz " * 5000
    d = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, "le " * 90_000, "b")], "doc_id long, text string, lang string")
    model = langid.fitted(d)
    want = _model(a=text, b="le " * 90_000)
    assert model.langs == ["a", "b"] and np.allclose(model.table, want.table, atol=1e-4)
    assert langid.sampled(d).count() == 2


def test_language(spark, docs, none):
    model = _model(en="the man and the house of the other one " * 3, fr="le jardin de la maison et les enfants du roi " * 3)
    rows = langid.identify(docs, model, host=F.col("source"), declared=F.col("lang")).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(TEXTS) and by[1].lang_found == "en" and by[6].lang_found == "fr" and by[1].kept
    assert not by[2].kept and not by[3].kept and not by[4].kept and by[2].lang_found is None
    assert langid.identify(none, model, host=F.col("source")).count() == 0
    host, domain, suffix = langid.address_parts(F.col("u"))
    u = spark.createDataFrame([("https://a.b.example.fr/x",), (None,)], "u string").select(host, domain, suffix).collect()
    assert tuple(u[0]) == ("a.b.example.fr", "example.fr", "fr") and u[1][0] is None


def test_language_host_prior(spark):
    """Of a text that says nothing either way, its host decides."""
    model = _model(x="aaa bbb " * 20, y="bbb ccc " * 20)
    d = spark.createDataFrame([(i, "ccc " * 30, "h") for i in range(40)] + [(100, "bbb", "h"), (101, "bbb", "other")], "doc_id long, text string, host string")
    by = {r.doc_id: r for r in langid.identify(d, model, host=F.col("host")).collect()}
    assert by[100].lang_found == "y" and by[100].probability > 0.8


def test_every_language_has_rows_in_the_fitting_sample(spark):
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2000 == 7, "rare").when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"), F.lit("some words").alias("text"))
    assert langid.fitted(d, sample=30).langs == ["a", "b", "rare"]
    assert langid.fitted(d.limit(0)).langs == ["und"]


def test_language_of_pages(spark):
    """Text, markup and address are all evidence; of a page that says nothing either way, its address decides."""
    model = _model(x="aaa bbb " * 20, y="bbb ccc " * 20)
    page = lambda lang, text: f"<html lang='{lang}-XX'><body><article><p>{text}</p></article></body></html>"
    rows = [(i, f"https://h{i}.site.yy/a", page("y", "ccc " * 30)) for i in range(30)] + [(i, f"https://h{i}.site.xx/a", page("x", "aaa " * 30)) for i in range(30, 60)]
    rows += [(100, "https://new.other.yy/b", "<p>bbb"), (101, "https://new.other.xx/b", "<p>bbb"), (102, None, page("y", "bbb")), (103, None, page("x", "bbb")), (104, None, None)]
    by = {r.page_id: r for r in langid.op3_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert len(by) == len(rows) and [by[i].lang_found for i in (0, 30, 100, 101, 102, 103, 104)] == ["y", "x", "y", "x", "y", "x", None]


def test_archives(spark, tmp_path):
    big = "x" * 1500
    rows = [(1, "http://b.com/1", big), (2, "http://a.com/1", big), (3, None, None), (4, "https://A.com:80/2?q#f", "é\r\n\r\nWARC/1.0\r\n"), (5, "http://a.com/1", big + "!"), (5, "http://a.com/1", big + "!"), (None, "http://c.com", big), (7, "u", "s"), (8, "u", "s")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    out = warc.op4(p.repartition(3)).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert (by[1].record_type, by[1].refers_to, by[1].payload_bytes) == ("revisit", 2, 1500)
    assert by[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert all(by[k].record_type == "response" for k in (2, 3, 4, 5, 7, 8, None)) and by[3].payload_bytes == 0
    keys = [(r.urlkey, r.captured) for r in out]
    assert keys == sorted(keys)
    assert warc.op4(p.limit(0)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_index_finds_records(spark, tmp_path, monkeypatch, compression):
    monkeypatch.setattr(warc, "RECORDS", 4)
    rows = [(i, f"http://a.org/{i % 5}", "é" * (i * 37 % 900) if i % 3 else "same" * 400) for i in range(30)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), str(tmp_path / "w"), compression)
    index = warc.merged(warc.read_runs(spark, str(tmp_path / "w"))).collect()
    assert len(index) == 30 and max(collections.Counter(r.archive for r in index).values()) <= 4
    for r in index:
        data = (tmp_path / "w" / r.archive).read_bytes()
        data = gzip.decompress(data) if compression == "gzip" else data
        record = data[r.record_offset : r.record_offset + r.record_bytes]
        assert record.startswith(b"WARC/1.0\r\n") and b"<urn:page:%d>" % r.page_id in record
        assert data[r.record_offset + r.record_bytes :][:4] == b"\r\n\r\n"
        if r.record_type == "response":
            assert hashlib.sha1(record.split(b"\r\n\r\n", 2)[2]).hexdigest() == r.payload_digest


def test_records_of_gzip_members():
    def record(block):
        return b"WARC/1.0\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)

    blocks = [b"", b"a\r\n\r\nb", b"z" * 5000]
    assert [b for _, b, *_ in warc.Records(b"".join(gzip.compress(record(b)) for b in blocks), step=7)] == blocks
    assert [b for _, b, *_ in warc.Records(b"".join(map(record, blocks)))] == blocks
    with pytest.raises(ValueError):
        list(warc.Records(record(b"abc")[:-6]))


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def _sets(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _groups(texts):
    s, root = {k: _sets(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s[k]), find(k)) for k in keys}


def _copies(rng):
    texts = ["", None, " \n ", "a", "A", "a b c d", "a b c d", "one TWO three four five", "ONE two\tthree\nfour five"]
    for _ in range(14):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 40)) for _ in range(rng.choice([1, 3, 5, 8, 30, 120]))]
        for _ in range(rng.randint(1, 10)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9)}"
            texts.append(" ".join(w + ["tail"] * rng.choice([0, 0, 0, 3])))
    rng.shuffle(texts)
    return {3 * i: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("block", [ngramjoin.BLOCK, 200])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    monkeypatch.setattr(ngramjoin, "MEMBERS", 8192 if block > 10_000 else 4)
    texts = _copies(random.Random(5))
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).withColumn("key", F.lit(1))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.near_duplicates(d).collect()}
    assert found == _groups(texts)


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, None), (9, "q r s t u v"), (9, "q r s t u v"), (None, "n o p q r s t")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in ngramjoin.one_of_each(d).collect()), key=repr)
    assert left == sorted([rows[0], rows[3], rows[4], rows[5], rows[7]], key=repr)


def test_shingles_of_long_texts():
    rng = random.Random(2)
    text = " ".join(str(rng.randint(0, 10**6)) for _ in range(400_000)).encode()
    assert len(text) > 2 * shingles.SLICE
    whole = next(shingles.shingle_sets([text]))
    again = list(shingles.shingle_sets([b"x y", text.replace(b" ", b"\n\t"), b""]))
    assert np.array_equal(whole, again[1]) and len(again[0]) == 1 and len(again[2]) == 0
    assert len(whole) == len({tuple(w) for w in zip(*[text.split()[i:] for i in range(5)], strict=False)})


@pytest.mark.parametrize("degree", [1, 20, 1 << 20])
def test_components(spark, monkeypatch, degree):
    monkeypatch.setattr("lodestrata.llm.common.HOT_DEGREE", degree)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_fingerprints(spark, docs, none):
    rows = [(i, t) for i, t in enumerate(["", "short", None, "abc " * 400, "äöü " * 50, "abc " * 399 + "end", LONG])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    texts, order = {i: t or "" for i, t in rows}, [i for i, _ in rows][::-1]
    for r in fingerprint.fingerprints(d, 3).collect():
        a, b = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        e = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        f = [fingerprint.digest(x.encode()) for x in (a, e, b)]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(a), hashlib.sha256(e.encode()).hexdigest(), f[0], f[1])
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(f[0], f[1]), fingerprint.likeness(f[0], f[2]))
    assert fingerprint.fingerprints(docs).count() == len(TEXTS) and fingerprint.fingerprints(none).count() == 0


def test_digest_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 3000):
        data = rng.bytes(n)
        assert fingerprint.counts(data).sum() == max(0, n - 2)
        assert fingerprint.likeness(fingerprint.digest(data), fingerprint.digest(data)) == 1.0
    a, b = fingerprint.digest(b"abc" * 500), fingerprint.digest(rng.bytes(9000))
    assert 0 <= fingerprint.likeness(a, b) < 0.8


PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">buy</div>
<article><h1>Head &amp; line</h1><p><b>One<br>two
  three.<p>Four, <i>five</i>.</p><ul><li>item<li>other</ul><aside>side</aside><form><input>send</form></article><div id="comments"><p>me too, yes.</p></div><footer>&copy; f</footer></body></html>"""


def test_pages(spark):
    want = "Head & line\nOne two three.\nFour, five.\nitem\nother"
    p = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (3, "v", ""), (4, "w", "<p>bare <p>text, here."), (5, "x", "no tags < at all")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    by = {r.page_id: r for r in htmlmain.extract(p).collect()}
    assert by[1].text == want and by[1].n_chars == len(want) and by[2].text == "" and by[3].n_chars == 0
    assert by[4].text == "bare\ntext, here." and by[5].text == "no tags < at all"
    assert htmlmain.extract(p.limit(0)).count() == 0


def test_page_without_article():
    body = "".join(f"<p>A long sentence, with commas, and words that go on for a while. Part {i}.</p>" for i in range(5))
    assert htmlmain.main_text(f"<body><ul><li><a>x</a><li>y</ul><div>{body}</div><div>foot</div></body>").count("\n") == 4


def test_ratios_decide_inside_a_named_wrapper():
    body = "".join(f"<p>A long sentence, with commas, and words that go on for a while. Part {i}.</p>" for i in range(5))
    links = "".join(f"<li><a href='/{i}'>link {i}</a>" for i in range(8))
    for wrapper in ("div class='main'", "div id='content'", "main", "article"):
        out = htmlmain.main_text(f"<body><{wrapper}><div><ul>{links}</ul></div><section>{body}</section><div>more</div></{wrapper.split()[0]}></body>")
        assert out.count("\n") == 4 and "link" not in out and "more" not in out


def test_names_mark_content_only_as_a_weight():
    body = "".join(f"<p>A long sentence, with commas, and words that go on for a while. Part {i}.</p>" for i in range(5))
    inside = "<div class='related-work'><p>Work like this, and other work, has been done before, by many others.</p></div>"
    assert "Work like this" in htmlmain.main_text(f"<body><nav><a>x</a></nav><article>{body}{inside}</article></body>")
    out = htmlmain.main_text(f"<body><div id='c1'>{body}</div><div class='post'>six words stand in this block</div></body>")
    assert out.count("A long sentence") == 5
    for name in ("ad", "site-header", "commentList", "cookie_notice", "related links"):
        assert "gone" not in htmlmain.main_text(f"<body><article>{body}</article><div class='{name}'><p>This is gone, with commas, and words, and all that.</p></div></body>")
    assert htmlmain.main_text(f"<article>{body}<p>a&nbsp;&nbsp;b, &#160;<label>c</label> <math><mi>d</mi></math></p></article>").endswith("\na b, c d")


def test_very_long_page():
    body = "<p>A sentence, with a comma.</p>" * 40_000
    assert htmlmain.main_text(f"<nav>menu</nav><article>{body}</article>").count("\n") == 39_999


def _targets(size):
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), [3, 1, 2] * len(size), strict=False))
    out, left = dict.fromkeys(size, 0.0), 1.5 * sum(size.values())
    while left > 1e-9:
        some = [s for s in size if out[s] < 2 * size[s] - 1e-9]
        w, more = sum(weight[s] for s in some), 0.0
        for s in some:
            out[s] += left * weight[s] / w
            if out[s] > 2 * size[s]:
                more, out[s] = more + out[s] - 2 * size[s], 2 * size[s]
        left = more
    return out


def test_mixing(spark, docs, none):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 900)) if i % 9 else None, rng.choice(["a", "b", "c", "d", None])) for i in range(300)] + [(7, "w w w", "tiny")] * 3
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(1))
    out = mixing.op9(d).collect()
    assert len(out) == len(rows)
    size, taken = collections.Counter(), collections.Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    goal = _targets(size)
    by_size = {v: k for k, v in size.items()}
    for r in out:
        s = by_size[r.source_size]
        assert abs(r.target - goal[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK for s in size)
    assert sorted(map(repr, mixing.op9(d.repartition(7)).collect())) == sorted(map(repr, out))
    assert mixing.op9(docs).count() == len(TEXTS) and mixing.op9(none).count() == 0


def test_permutations_and_draws():
    for n in (1, 2, 3, 64, 1000):
        p = mixing.permuted(np.arange(n), n, 9)
        assert sorted(p) == list(range(n))
    # a shard's groups and sources share out what it draws
    share = [0.4, 0.7, 0.2, 0.9, 0.8]
    groups = [sum(share[:2]), sum(share[2:])]
    for shard in range(5):
        n = sum(mixing.shard_counts(shard, 3.0, groups, g, share[:2] if g == 0 else share[2:], 3).sum() for g in range(2))
        assert n == 3


def test_taken_is_the_sum_of_what_the_shards_draw(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 2)
    d = spark.createDataFrame([(i, " ".join(["w"] * (i % 97 + 5)), "abcde"[i % 5]) for i in range(400)], "doc_id long, text string, source string")
    taken = {}
    for slots in (7, 40, 10_000):
        mix = mixing.Mix(d, block=8, shard_slots=slots)
        drawn = {r.source_id: r.n for r in mix.draws.groupBy("source_id").agg(F.sum("n").alias("n")).collect()}
        used = {r.source_id: r.n for r in mix.slots.groupBy("source_id").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("k")).where("n = k").collect()}
        want = {r.source_id: (r.target, -(-r.source_size // 8), r.source_size) for r in mix.sources.collect()}
        assert used == {k: min(n, 2 * want[k][1]) for k, n in drawn.items()}
        shards = mix.draws.agg(F.max("shard")).first()[0] + 1
        for k, (target, blocks, size) in want.items():
            assert abs(drawn[k] - target * blocks / size) <= 1 + 4 * (shards / 4) ** 0.5
        assert mix.slots.groupBy("source_id", "block").count().agg(F.max("count")).first()[0] <= 2
        taken[slots] = drawn
    assert taken[7] != taken[10_000]


def test_mixture_texts(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(50 + i)), "ab"[i % 2], 5) for i in range(30)] + [(3, "same id\nother text", "b", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = mixing.mixture(d).collect()
    words = collections.Counter(w for r in out for w in r.text.split())
    assert max(words.values()) <= 2 and set(words) <= {w for _, t, *_ in rows for w in t.split()}
    assert abs(sum(words.values()) - 1.5 * sum(len(t.split()) for _, t, *_ in rows)) < 3 * mixing.BLOCK
    assert all(r.n_chars == len(r.text) for r in out)


@pytest.mark.skipif(not os.path.isdir("/opt/tokenizers"), reason="needs the vocabulary")
def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    path = "/opt/tokenizers/word_bpe_49k.json"
    whole = Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = ["", None, "don't DON'T Straße ½ x2 ... I'll", "日本語 text", "ȺB Ɓa Ŀx ŉ", "a<|endoftext|>b", "İstanbul ΣΑΣ é", "tab\tand space\x1cend", "word " * 5000]
    texts += [" ".join(rng.choice(["alpha", "Beta,", "gamma7", "d'accord", "über"]) for _ in range(rng.randint(1, 1500))) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rid", F.lit(1))
    rows = packing.packed(packing.pieces(d, path)).collect()
    seq, by = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append((r.offset, r.length))
        by[r.doc_id].append(r)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    for i, t in enumerate(texts):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(by[i], key=lambda r: r.piece)
        assert [r.length for r in mine] == [min(2048, len(ids) - a) for a in range(0, len(ids), 2048)]
        for r in mine:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part)), t
    assert len(seq) <= packing.least_bins([r.length for r in rows]) + 1
    assert packing.packed(packing.pieces(none, path)).count() == 0
    assert packing.packed(packing.pieces(docs, path)).where("piece = 0").count() == len(TEXTS)


def _hard(n, seed):
    """Lengths of which three and four make a sequence, so that best fit leaves gaps."""
    rng = random.Random(seed)
    return [rng.randint(400, 1100) for _ in range(n)]


def test_evolve_beats_best_fit():
    for n in (120, 500):
        sizes = _hard(n, 1)
        first, best = packing.fit(sorted(range(n), key=lambda i: -sizes[i]), sizes, []), packing.evolve(sizes, 1)
        assert sorted(i for b in best for i in b) == list(range(n))
        assert all(sum(sizes[i] for i in b) <= packing.SEQUENCE for b in best)
        assert packing.least_bins(sizes) <= len(best) < len(first) - 1


def test_islands_are_tasks_and_send_elites(spark, monkeypatch):
    sizes = _hard(300, 4)
    d = spark.createDataFrame([(i, n, i % 2) for i, n in enumerate(sizes)], "rid long, length long, chunk long")
    found = packing._searched(d).collect()
    for r in found:
        mine = [n for i, n in enumerate(sizes) if i % 2 == r.chunk]
        bins = packing._bins(r.packing)
        assert sorted(i for b in bins for i in b) == list(range(150)) and np.frombuffer(r.sizes, np.int32).tolist() == mine
        assert max(sum(mine[i] for i in b) for b in bins) <= packing.SEQUENCE
        assert len(bins) < len(packing.fit(sorted(range(150), key=lambda i: -mine[i]), mine, []))
        assert len(bins) == len(packing.evolve(mine, r.chunk))  # the same epochs, in one process
    worse, better = packing.first_population(sizes, 1), packing.evolve(sizes, 3)
    monkeypatch.setattr(packing, "GENERATIONS", 0)
    assert packing.epoch(worse, better, sizes, 0, 1)[0] == better


def test_pieces_of_many_chunks_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 64)
    sizes = _hard(400, 6)
    cut = spark.createDataFrame([(i, 0, 0, n, 7) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    by = collections.defaultdict(list)
    for r in packing.packed(cut).collect():
        by[r.sequence_id].append((r.offset, r.length))
    assert sum(map(len, by.values())) == 400
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= packing.SEQUENCE
    assert len(by) < len(packing.fit(sorted(range(400), key=lambda i: -sizes[i]), sizes, []))


def test_repeated_passages(spark, none):
    rng = random.Random(7)

    def some(n):
        return " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))

    passage, line = some(55), some(60).split()
    near = [*line[:30], "changed", *line[31:]]
    rows = [(i, "\n".join(some(rng.randint(5, 80)) for _ in range(3))) for i in range(20)]
    rows += [(100, some(33) + " " + passage + " " + some(21)), (101, some(7) + "\n" + passage), (102, passage + " " + some(90)), (103, some(9) + "\n" + " ".join(line) + "\n" + some(5)), (104, " ".join(near))]
    rows += [(105, None), (106, ""), (107, "short " * 3), (None, passage), (108, "again and " * 30), (109, some(80))]
    rows += [rows[-1]]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).repartition(3)
    found = {r.doc_id: r for r in paragraphs.repeats(d).collect()}
    assert set(found) == {100, 101, 102, 103, 104}
    texts = dict(rows)
    for i in (100, 101, 102):
        (a, z), *more = [tuple(map(int, x.split(":"))) for x in found[i].spans.split(",")]
        assert not more and z - a >= 32 and " ".join(texts[i].split()[a:z]) in passage
    assert [found[i].n_removed > 0 for i in (100, 101, 102, 103, 104)] == [False, True, True, False, True]
    assert (found[103].spans, found[104].removed) == ("9:69", "0:60")
    cut = {r.doc_id: r.text for r in paragraphs.without_repeats(d.where("doc_id >= 100")).collect()}
    assert cut[100] == texts[100] and cut[104] == "" and len(cut[101].split()) == 7 + 55 - found[101].n_removed
    assert cut[105] is None and paragraphs.repeats(none).count() == 0


def test_any_shared_passage_holds_an_anchored_paragraph():
    rng = np.random.default_rng(3)
    n = paragraphs.WORDS + paragraphs.SPREAD
    for _ in range(200):
        p = rng.integers(0, 2**63, n).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64), p, rng.integers(0, 2**63, rng.integers(0, 60)).astype(np.uint64)]) for _ in range(2))
        assert set(paragraphs.windows(a)[1].tolist()) & set(paragraphs.windows(b)[1].tolist())


def test_shared_passages_of_few_distinct_words():
    rng = np.random.default_rng(4)
    some = lambda n: rng.integers(0, 4, n).astype(np.uint64)
    for _ in range(300):
        p = some(paragraphs.WORDS + paragraphs.SPREAD - 1)
        (i, x), (j, y) = (paragraphs.windows(np.concatenate([before, p, some(rng.integers(0, 60))])) for before in (some(rng.integers(0, 60)), some(rng.integers(0, 60))))
        assert set(x.tolist()) & set(y.tolist())
    assert max(np.diff(paragraphs.windows(some(2000))[0])) <= paragraphs.SPREAD


def test_bands_reach_their_recall():
    b, r = paragraphs.tuned(0.8, 0.99)
    assert 1 - (1 - 0.8**r) ** b >= 0.99 and (b, r) == (paragraphs.BANDS, paragraphs.ROWS)


def test_lines_near_to_others_than_the_first_of_their_buckets(spark):
    rng = random.Random(11)

    def some(n):
        return [f"w{rng.randint(0, 10**6)}" for _ in range(n)]

    line = some(60)
    rows = []
    for i in range(200):  # each shares some shingles of the line, and so leads some of its buckets, but is near to none
        own = list(line)
        for a in (10, 20, 30, 40):
            own[rng.randint(a, a + 9)] = some(1)[0]
        rows.append((i, " ".join(own)))
    rows += [(500, " ".join(line)), (501, " ".join([*line[:30], "changed", *line[31:]])), (502, " ".join(line[:29] + ["other"] + line[30:]))]
    found = {r.doc_id: r.removed for r in paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {500: "", 501: "0:60", 502: "0:60"}


def test_chains_of_near_lines_against_brute_force(spark):
    """Of lines each near to the one before it, brute force over all pairs removes all but the first; the bands promise 99 of 100 pairs."""
    rng = random.Random(21)
    rows, at = [], 0
    for _ in range(70):
        line = [f"w{rng.randint(0, 10**7)}" for _ in range(rng.randint(50, 90))]
        for _ in range(6):
            rows.append((at, "short one\n" + " ".join(line)))
            at += 1
            line = list(line)
            line[rng.randrange(len(line))] = f"w{rng.randint(0, 10**7)}"
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split("\n")[1].split() for _, t in rows)]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    by = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by[g].add(i)
    for i, s in enumerate(sets):
        for j in set().union(*(by[g] for g in s)):
            if j > i and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    want = {i for i in range(len(rows)) if top(i) != i}
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in paragraphs.repeats(d).where("n_removed >= 50").collect()}
    assert len(want) > 300 and got <= want and len(want & got) >= 0.99 * len(want)


def test_short_lines_that_repeat(spark):
    """Equal documents of LEAST words and more are found, of fewer are not."""
    some = lambda n, k: " ".join(f"w{k}_{i}" for i in range(n))
    rows = [(n * 10 + i, some(n, n)) for n in (15, 16, 20, 31, 32) for i in range(5)]
    found = {r.doc_id: (r.n_repeated, r.n_removed) for r in paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {n * 10 + i: (n, n if i else 0) for n in (16, 20, 31, 32) for i in range(5)}


def test_line_sets_against_single_lines():
    text = ["a b c d e f g h i j k l m n o p q\nx y\n" + "r s t u " * 10, "", "one two " * 12]
    b = pa.RecordBatch.from_arrays([pa.array([4, 5, 6]), pa.array(text)], ["doc_id", "text"])
    rows = [r for out in paragraphs._line_sets(iter([b])) for r in out.to_pylist()]
    assert [(r["doc_id"], r["start"], r["n"]) for r in rows] == [(4, 0, 17), (4, 19, 40), (6, 0, 24)]
    lines = [text[0].split("\n")[0], text[0].split("\n")[2], text[2]]
    for r, t in zip(rows, lines, strict=True):
        assert np.frombuffer(r["shingles"], np.uint64).tolist() == next(iter(shingles.shingle_sets([t.encode()]))).tolist()


def test_common_counts(monkeypatch):
    monkeypatch.setattr(paragraphs, "COLUMNS", 7)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 60))).astype(np.uint64) for _ in range(12)]
    common = paragraphs._common(sets)
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(12) if i != j)
