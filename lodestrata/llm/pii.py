"""Personal data: proposed spans, boosted trees, redaction [native].

Generators scan each text with one pattern per kind and propose spans, which may overlap between kinds.
The four base kinds are exact: what they find stays. Spans of the other kinds go through boosted trees
over format and context features (pii_model), whose thresholds were calibrated to a precision; the trees
run as CASE expressions. Nothing is shuffled and nothing leaves the JVM.

Positions come from splitting a text by the same pattern that extracts the matches: a match starts where
the pieces and matches before it end. They count code points.

A null or empty text has no spans; repeated rows give repeated rows; other columns, of whatever name, are
kept by redact(). Spans of equal starts are redacted under the shorter one's kind, then under the kind first by
name. A text's spans are held as arrays, so memory is bounded by the longest text. A match never crosses a line, and the patterns do not backtrack over long
runs (possessive), so time is near linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import pii_model as M
from lodestrata.llm.common import fresh

_LOCAL = "A-Za-z0-9._%+-"
#: kind -> (pattern, what a text must have for it to be tried). A run is tried from its start or from the end of a match only: a later start in it finds nothing that the first does not.
BASE = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: High-recall generators of the other kinds.
MORE = {
    "email_alt": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++\x20?[(\[{{][aA][tT][)\]}}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{{][dD][oO][tT][)\]}}]\x20?)[A-Za-z0-9-]++)*+", r"[(\[{][aA][tT][)\]}]"),
    "phone_alt": (r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])", r"[0-9]\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3}"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]-[0-9]{2}-[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "hwaddr": (r"(?:[0-9A-Fa-f]{1,4}:){2,7}[0-9A-Fa-f]{1,4}", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "secret": (r"[A-Za-z0-9_/+=-]{16,}+", r"[A-Za-z0-9_/+=-]{16}"),
}
KINDS = (*BASE, *MORE)
#: Characters before and after a span that its context features see.
BEFORE, AFTER = 24, 8
_CHUNK = 64


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    twice = lambda c, i: F.when(i % 2 == 1, F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    total = F.aggregate(F.transform(F.split(F.reverse(d), ""), lambda c, i: twice(c.cast("int"), i)), F.lit(0), lambda a, c: a + c)
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), _luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "secret":
        return m.rlike("[0-9]")
    return F.lit(True)


def _count(m: Column, kind: str) -> Column:
    return F.length(m) - F.length(F.regexp_replace(m, kind, ""))


def _features(kind: str, m: Column, left: Column, right: Column) -> Column:
    word = lambda c: F.coalesce(c.rlike("^[A-Za-z0-9_]"), F.lit(False)).cast("int")
    f = [F.lit(M.KINDS.index(kind)), F.length(m), _count(m, "[0-9]"), _count(m, "[A-Z]"), _count(m, "[a-z]"), F.size(F.array_distinct(F.split(m, ""))), _count(m, "[^A-Za-z0-9 ]"), word(F.substring(left, -1, 1)), word(F.substring(right, 1, 1))]
    f += [F.lower(left).rlike(h).cast("int") for h in M.HINTS.values()]
    return F.struct(*[c.cast("int").alias(n) for n, c in zip(M.FEATURES, f, strict=True)])


def _score(tree, x: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(x[M.FEATURES[tree[0]]] < tree[1], _score(tree[2], x)).otherwise(_score(tree[3], x))


def _tail(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.substring(s, -n, n)).otherwise(s)


def with_spans(docs: DataFrame, text: str = "text", to: str = "spans", trees: bool = True) -> DataFrame:
    """docs with an array of struct(kind, start, end) added, by kind as listed, then start; the end is exclusive."""
    kinds = KINDS if trees else tuple(BASE)
    pats = BASE | MORE
    # the row travels as one struct, so that its columns may bear any name
    d = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    none = F.array().cast("array<string>")
    # one scan tells most texts from those that a generator is tried on
    d = d.withColumn("_any", F.col("_t").rlike(r"[0-9@]|[(\[{][aA][tT][)\]}]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"))
    tried = {k: F.when(F.col("_any") & F.col("_t").rlike(pats[k][1]), F.lit(True)).otherwise(F.lit(False)) for k in kinds}
    d = d.withColumns({f"_c_{k}": c for k, c in tried.items()})
    d = d.withColumns({f"_m_{k}": F.when(F.col(f"_c_{k}"), F.regexp_extract_all("_t", F.lit(pats[k][0]), 0)).otherwise(none) for k in kinds})
    d = d.withColumns({f"_p_{k}": F.when(F.size(f"_m_{k}") > 0, F.split("_t", pats[k][0], -1)).otherwise(none) for k in kinds})
    length = lambda c: F.length(c).cast("long")
    zero = F.lit(0).cast("long")
    seg = lambda k: F.transform(f"_m_{k}", lambda _, i: length(F.get(f"_p_{k}", i)) + F.when(i > 0, length(F.get(f"_m_{k}", i - 1))).otherwise(zero))
    d = d.withColumns({f"_s_{k}": seg(k) for k in kinds})
    # running sums in two levels, so that a text with many matches costs no square of their number
    add = lambda arr, lo, hi: F.aggregate(F.sequence(lo, hi), zero, lambda a, j: a + F.get(arr, j))
    n = lambda k: F.size(f"_s_{k}")
    chunks = lambda k: F.when(n(k) > 0, F.transform(F.sequence(F.lit(0), F.floor((n(k) - 1) / _CHUNK).cast("int")), lambda c: add(f"_s_{k}", c * _CHUNK, F.least(c * _CHUNK + _CHUNK - 1, n(k) - 1)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumns({f"_k_{k}": chunks(k) for k in kinds})
    before = lambda k: F.transform(f"_k_{k}", lambda _, c: F.when(c > 0, add(f"_k_{k}", F.lit(0), c - 1)).otherwise(zero))
    d = d.withColumns({f"_q_{k}": before(k) for k in kinds})

    def found(k: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            c = F.floor(i / _CHUNK).cast("int")
            start = F.get(f"_q_{k}", c) + add(f"_s_{k}", c * _CHUNK, i)
            fields = [F.lit(k).alias("kind"), start.alias("start"), (start + F.length(m)).cast("long").alias("end"), m.alias("m")]
            if k in MORE:
                fields += [_features(k, m, _tail(F.get(f"_p_{k}", i), BEFORE), F.substring(F.get(f"_p_{k}", i + 1), 1, AFTER)).alias("x")]
            return F.struct(*fields)

        return F.filter(F.when(F.size(f"_q_{k}") >= 0, F.transform(f"_m_{k}", one)), lambda s: _valid(k, s["m"]))

    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    d = d.withColumn("_base", F.concat(*[bare(found(k)) for k in BASE]))
    if trees:
        forest, cuts = M.fitted()

        def chosen(s: Column) -> Column:
            cut = F.lit(cuts[-1])
            for i, c in enumerate(cuts[:-1]):
                cut = F.when(s["x"]["kind"] == i, F.lit(c)).otherwise(cut)
            return sum((_score(t, s["x"]) for t in forest[1:]), _score(forest[0], s["x"])) > cut

        # the kind is a feature, so the trees stand in the plan once
        d = d.withColumn("_more", F.concat(*[found(k) for k in MORE]))
        spans = F.when(F.size("_more") > 0, F.concat("_base", bare(F.filter("_more", chosen)))).otherwise(F.col("_base"))
    else:
        spans = F.col("_base")
    return d.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c != to], spans.alias(to))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in the text replaced by its kind in brackets; overlapping spans are joined under the first one's kind."""
    (at,) = fresh(docs, "_spans")
    d = with_spans(docs, text, at)
    d = d.withColumn(at, F.sort_array(F.transform(at, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    t = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    cut = F.aggregate(at, start, step, lambda a: F.concat(a["out"], t.substr((a["at"] + 1).cast("int"), F.length(t))))
    return d.withColumn(text, F.when(F.size(at) > 0, cut).otherwise(t)).drop(at)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2(docs: DataFrame) -> DataFrame:
    d = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    d = d.withColumn("base", base)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *[n(k) for k in BASE], F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))
