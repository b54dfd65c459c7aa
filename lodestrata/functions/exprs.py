"""Scalar functions as Column expressions: all run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, as a class of Java and of RE2.
SPACE_CLASS = "[\\t-\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def js_round(x: Column) -> Column:
    """Half goes up, also below zero; Spark's round() goes away from zero."""
    return F.floor(x + F.lit(0.5)).cast("long")


def saved_pct(returned: Column, would_be: Column) -> Column:
    return F.when(would_be > 0, js_round((1 - returned / would_be) * 100)).otherwise(F.lit(0)).cast("long")


def utf16_length(s: Column) -> Column:
    """Length in UTF-16 units: characters beyond the first plane count twice."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def token_estimate(s: Column) -> Column:
    """Quarter of the length, less up to 30 percent by the share of white space; 0 for an empty text."""
    n = utf16_length(s)
    # one match for each word, not for each character; white space is in the first plane
    ws = F.length(F.regexp_replace(s, SPACE_CLASS.replace("[", "[^", 1) + "++", ""))
    return F.when(n == 0, F.lit(0)).otherwise(F.ceil(F.ceil(n / 4) * (1 - 0.3 * ws / n))).cast("long")


def keeps_whole(outline_tokens: Column, full_tokens: Column, most: Column | None = None) -> Column:
    """Whether the whole file goes out because its outline saves too little, and fits the limit, if any."""
    c = outline_tokens >= 0.7 * full_tokens
    return c if most is None else c & (most.isNull() | (full_tokens <= most))


def savings_category(text: Column) -> Column:
    return F.when(text.startswith("REMINDER:") | text.startswith("DEDUP:"), "dedup").when(text.contains("returned in full, below threshold") | text.contains("returned in full, outline not smaller"), "none").otherwise("compression")


def confidence(score: Column) -> Column:
    return F.when(score >= 5, "high").when(score >= 2, "medium").otherwise("low")


def confidence_score(resolved: Column, full: Column, tests: Column, callers: Column, refs: Column, ast: Column, truncated: Column, deps: Column, dedup: Column) -> Column:
    """Weighted evidence; unknown (null) evidence counts nothing."""
    yes = lambda c, w: F.when(c, w).otherwise(0)
    return (
        F.when(resolved, 3).when(~resolved, -2).otherwise(0) + yes(full, 2) + yes(tests, 1) + yes(callers, 1) + yes(refs, 2)
        + F.when(ast, 1).when(~ast, -1).otherwise(0) + yes(truncated, -2) + yes(deps > 3, -1) + yes(dedup, 1)
    )


def duration(ms: Column) -> Column:
    """Whole seconds; minutes and seconds; hours and minutes."""
    s = F.floor(ms / 1000)
    m = F.floor(s / 60)
    text = lambda *parts: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in parts])
    return F.when(s < 60, text(s, "s")).when(m < 60, text(m, "m ", s % 60, "s")).otherwise(text(F.floor(m / 60), "h ", m % 60, "m"))


def _fixed(x: Column) -> Column:
    """One digit behind the point, of the nearest tenth; a tie goes up, and there are none but at whole twentieths."""
    tenths = F.floor(x * 10 + F.lit(0.5)).cast("long")
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def short_tokens(n: Column, whole: bool = False) -> Column:
    """Thousands as k with one digit, or whole ones; millions as M with one digit."""
    k = js_round(n / 1000).cast("string") if whole else _fixed(n / 1000)
    return F.when(n >= 1_000_000, F.concat(_fixed(n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(k, F.lit("k"))).otherwise(n.cast("string"))


def version_key(v: Column) -> Column:
    """The first dotted number of a version as an array of integers, which Spark compares part by part."""
    return F.transform(F.split(F.regexp_extract(v, "([0-9]+(?:\\.[0-9]+)*)", 1), "\\."), lambda x: x.try_cast("int"))


def int_or_null(s: Column) -> Column:
    return F.when(s.rlike("^-?[0-9]+$"), s.try_cast("bigint"))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), "^.+(\\.[^.]*)$", 1)


def test_path(path: Column) -> Column:
    """Where the tests of a source file stand by convention."""
    in_src = path.startswith("src/")
    named = F.regexp_replace(path, "\\.([^./]+)$", ".test.$1")
    return F.when(in_src, F.regexp_replace(named, "^src/", "tests/")).otherwise(named)


def source_name(path: Column) -> Column:
    """A test's file name without its mark."""
    return F.regexp_replace(basename(path), "(\\.test|\\.spec|_test|_spec)(\\.[^.]+)$", "$2")


def error_class(code: Column, name: Column, message: Column) -> Column:
    has = lambda x: F.lower(message).contains(x)
    return F.coalesce(F.when(code != "", code), F.when(name == "SyntaxError", "parse_error").when(name == "TypeError", "type_error").when(has("timeout"), "timeout").when(has("not initialized"), "not_initialized").when(has("permission denied"), "EACCES").otherwise("unknown"))


def response_budget(text: Column) -> Column:
    return F.regexp_extract(text, "Response budget: ~([0-9]{2,6}) tokens", 1).try_cast("int")


def snapshot_goal(text: Column) -> Column:
    return F.left(F.regexp_extract(text, "(?m)^\\*\\*Goal:\\*\\*[ \\t]*(.*)$", 1), F.lit(100))
