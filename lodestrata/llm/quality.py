"""Quality rules as a bitmask ledger [native].

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed
rule; policies, which are versioned masks, are applied to the bits afterwards, and ablations are
counts over distinct bit patterns. Nothing is shuffled to build the ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import words_of

#: Words in a window; a window found twice or more marks its words as repeated.
WINDOW = 5
#: Rule name -> condition for failure over the measurements, in integer arithmetic. A rule's bit is its place here.
#: Distinct words grow about with the root of all words, so their square is held against these, at any length.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "odd_word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "shouting": "n_upper > 50 and 2 * n_upper > word_chars",
    "exclaiming": "5 * n_exclaim > n_words",
    "few_distinct_words": "n_words >= 20 and n_distinct_words * n_distinct_words < 4 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A document is kept if none of the policy's rules failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, tuple(RULES))
LENIENT = Policy("lenient", 1, ("few_words", "repeated_windows", "many_symbols", "repeated_lines"))
POLICIES = {(p.name, p.version): p for p in (BASE, STANDARD, LENIENT)}


def _gone(text: Column, kind: str) -> Column:
    """How many characters of an ASCII class the text has."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, kind, ""))).cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, the measurements (long) and `failed`, the bits of the failed rules (long).

    A null or empty text has no words and fails few_words. Repeated rows give repeated rows; a null
    doc_id stays null; other columns are ignored. Words of a text are held as one array, so memory is
    bounded by the longest text.
    """
    d = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("w", words_of(F.col("t"))).withColumn("ls", F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    d = d.withColumn("h", F.when(F.size("w") >= WINDOW, grams).otherwise(F.array().cast("array<bigint>")))
    # only a text that has a window twice pays for the sort that finds where
    d = d.withColumn("again", F.size(F.array_distinct("h")) < F.size("h"))
    at = F.when(F.col("again"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    d = d.withColumn("s", at)
    same = lambda x, k: F.coalesce(F.get("s", k)["x"] == x["x"], F.lit(False))
    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.get("p", i + 1) - x, F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x)
    m = d.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _gone(F.col("t"), "[#*$%&|<>]").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("ls").cast("long").alias("n_lines"),
        _gone(F.col("t"), "[A-Z]").alias("n_upper"),
        _gone(F.col("t"), "!").alias("n_exclaim"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
    )
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())), F.lit(0).cast("long"))
    return m.withColumn("failed", bits)


def passes(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents it fails, documents only it fails, and what the policy would keep without it.

    Documents are first counted by bit pattern, so what is shuffled does not grow with their number.
    """
    by = led.groupBy("failed").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << list(RULES).index(r)).cast("long").alias("bit")) for r in policy.rules]))
    x = by.select("failed", "n", rules.alias("r")).select("n", "r.rule", "r.bit", F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("f"))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return x.groupBy("rule").agg(
        count(F.col("f").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("f") == F.col("bit")).alias("n_only"),
        count((F.col("f") == 0) | (F.col("f") == F.col("bit"))).alias("n_kept_without"),
        F.bit_or("f").alias("seen_with"),
    )


def op1(docs: DataFrame) -> DataFrame:
    led = ledger(docs)
    out = led.withColumn("base_failed", ~passes(BASE)).withColumn("kept", passes(STANDARD))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper", "n_exclaim", "n_distinct_words", "failed")


OP1_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (
  SELECT rid, unnest(range(1, len(ws) - 3)) AS i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS gram
  FROM w WHERE len(ws) >= 5),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 5) r(k) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
         length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaim, len(list_distinct(ws))::BIGINT AS n_distinct_words
  FROM w LEFT JOIN covered USING (rid)),
f AS (SELECT *, ({bits})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {base}) <> 0 AS base_failed,
       (failed & {standard}) = 0 AS kept, n_lines, n_upper, n_exclaim, n_distinct_words, failed
FROM f
""".replace("{bits}", " + ".join(f"CASE WHEN {r} THEN {1 << k} ELSE 0 END" for k, r in enumerate(RULES.values()))).replace("{base}", str(BASE.mask)).replace("{standard}", str(STANDARD.mask))
