"""Documents in structured notations: nested YAML, CSV with quotes, JSON by type. A file is one row and stays one: nothing is shuffled."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.exprs import SPACE_CLASS
from lodestrata.runtime import ship

#: Levels of a YAML outline, and keys that a node shows.
YAML_LEVELS, YAML_KEYS = 3, 20
#: Rows of a CSV outline.
CSV_SAMPLE = 5
#: What a key and a list item of YAML look like, and how values begin that are no scalars.
YAML_KEY = re.compile(r"^(\s*)([a-zA-Z_][a-zA-Z0-9_.-]*):\s*(.*)")
YAML_ITEM = re.compile(r"^(\s*)- ")
YAML_NESTED = ("{", "[", "|", ">")

YAML_SHAPE = "path string, ord int, depth int, key string, key_path string, value string, n_keys int, n_items int, start_line long, end_line long"


def yaml_nodes(content: str) -> list[tuple]:
    """The shown keys of a YAML text: (ord, depth, key, key_path, value, n_keys, n_items, start_line, end_line).

    A stack holds the keys that are open at a line; a line of less or equal indent closes them. A list item closes likewise
    and counts for the key that is left open. A node keeps its first YAML_KEYS keys, and YAML_LEVELS levels are shown.
    """
    lines = content.split("\n")
    nodes: list[dict] = []
    open_: list[dict] = []
    unended: list[dict] = []  # as open_, but list items end nothing: a key's lines go on to the next key

    def close(stack: list[dict], indent: int) -> list[dict]:
        closed = []
        while stack and stack[-1]["indent"] >= indent:
            closed.append(stack.pop())
        return closed

    for no, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if m := YAML_ITEM.match(line):
            close(open_, len(m[1]))
            if open_:
                open_[-1]["items"] += 1
            continue
        if not (m := YAML_KEY.match(line)):
            continue
        value = m[3].split("#", 1)[0].strip()
        close(open_, len(m[1]))
        for n in close(unended, len(m[1])):
            n["end"] = no - 1
        above = open_[-1] if open_ else None
        kept = above is None or (above["kept"] and above["depth"] < YAML_LEVELS)
        if above is not None:
            kept = kept and above["keys"] < YAML_KEYS
            above["keys"] = min(YAML_KEYS, above["keys"] + 1)
        node = {
            "kept": kept, "depth": above["depth"] + 1 if above else 1, "key": m[2], "path": f"{above['path']}.{m[2]}" if above else m[2], "indent": len(m[1]),
            "value": value if value and not value.startswith(YAML_NESTED) else None, "keys": 0, "items": 0, "start": no, "end": len(lines),
        }
        nodes.append(node)
        open_.append(node)
        unended.append(node)
    shown = [n for n in nodes if n["kept"]]
    return [(i, n["depth"], n["key"], n["path"], n["value"], n["keys"], n["items"], n["start"], n["end"]) for i, n in enumerate(shown)]


def _yaml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    names = [f.split()[0] for f in YAML_SHAPE.split(", ")]
    for b in batches:
        rows = [(p, *n) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for n in yaml_nodes(c or "")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)


def yaml_outline(files: DataFrame) -> DataFrame:
    """The keys of YAML files (path, content), nested, with their lines, values, and numbers of keys and list items below."""
    ship(files.sparkSession)
    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(_yaml, YAML_SHAPE)


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def csv_fields(line: Column) -> Column:
    """The fields of a line of CSV. Quotes may open anywhere; inside them commas are text and a doubled quote is one.

    Cut at quotes, the parts of a line lie outside and inside by turns. An empty part outside between two inside is the
    second half of a doubled quote. \\x01 marks commas that separate; where a text has it itself, it is written as two.
    """
    mark, own = "\x01b", "\x01a"
    parts = F.split(F.replace(line, F.lit("\x01"), F.lit(own)), '"', -1)
    last = F.size(parts) - 1

    def part(x: Column, i: Column) -> Column:
        outside = i % 2 == 0
        doubled = outside & (x == "") & (i > 0) & (i < last)
        return F.when(doubled, F.lit('"')).when(outside, F.replace(x, F.lit(","), F.lit(mark))).otherwise(x)

    joined = F.array_join(F.transform(parts, part), "")
    return F.transform(F.split(joined, mark, -1), lambda x: _trimmed(F.replace(x, F.lit(own), F.lit("\x01"))))


def csv_outline(files: DataFrame, sample: int = CSV_SAMPLE) -> DataFrame:
    """path, columns, row_count and sample of CSV files (path, content); blank lines count for nothing, and records end with the line."""
    lines = F.filter(F.split(F.coalesce("content", F.lit("")), "\n", -1), lambda x: _trimmed(x) != "")
    d = files.select("path", lines.alias("l"))
    none = F.array().cast("array<string>")
    return d.select(
        "path", F.when(F.size("l") > 0, csv_fields(F.get("l", F.lit(0)))).otherwise(none).alias("columns"),
        F.greatest(F.size("l") - 1, F.lit(0)).cast("long").alias("row_count"),
        F.transform(F.slice("l", 2, sample), csv_fields).alias("sample"),
    )


def _as_map(v: Column) -> Column:
    return v.cast("map<string,variant>")


def parsed(text: Column) -> Column:
    """A JSON text as a variant; null if it is none. The parser stops at the end of a value, so what follows it is read, too, as part of an array."""
    one = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).cast("array<variant>")
    return F.when(F.size(one) == 1, F.get(one, F.lit(0)))


def variant_kind(v: Column) -> Column:
    """What kind of value a JSON value is; arrays and objects with their sizes. A null is an object, as it is where the notation comes from."""
    s = F.schema_of_variant(v)
    sized = lambda open_, n, close: F.concat(F.lit(open_), n.cast("string"), F.lit(close))
    return (
        F.when(s.startswith("ARRAY"), sized("array[", F.size(v.cast("array<variant>")), "]"))
        .when(s.startswith("OBJECT"), sized("object{", F.size(_as_map(v)), " keys}"))
        .when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "object").when(s.isNotNull(), "number")
    )


def json_outline(docs: DataFrame, column: str, id_col: str) -> DataFrame:
    """The keys of JSON objects with the kind of each value; texts that are no JSON, or no object, have none."""
    d = docs.select(id_col, parsed(F.col(column)).alias("_v"))
    d = d.where(F.schema_of_variant("_v").startswith("OBJECT"))
    return d.select(id_col, F.explode(_as_map(F.col("_v"))).alias("key", "_x")).select(id_col, "key", variant_kind(F.col("_x")).alias("kind"))


def json_shape(docs: DataFrame, column: str, id_col: str) -> DataFrame:
    """id, kind of the whole (null where a text is no JSON), and the keys of an array's first item if that is an object."""
    d = docs.select(id_col, parsed(F.col(column)).alias("_v"))
    is_array = F.schema_of_variant("_v").startswith("ARRAY")
    first = F.when(is_array, F.get(F.col("_v").cast("array<variant>"), F.lit(0)))
    d = d.withColumn("_first", first)
    keys = F.when(F.schema_of_variant("_first").startswith("OBJECT"), F.array_sort(F.map_keys(_as_map(F.col("_first")))))
    return d.select(id_col, variant_kind(F.col("_v")).alias("kind"), keys.alias("item_keys"))


def js_number(x: float) -> str:
    """A number as JSON writes it: no exponent from 1e-6 to below 1e21, the fewest digits that read back."""
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    digits, _, exponent = f"{x!r}".lower().partition("e")
    sign = "-" if digits.startswith("-") else ""
    whole, _, part = digits.lstrip("-").partition(".")
    part = "" if part == "0" and not exponent else part
    point = len(whole) + int(exponent or 0)
    both = whole + part
    lead = len(both) - len(both.lstrip("0"))
    both, point = both[lead:].rstrip("0"), point - lead
    if 0 < point <= 21:
        return sign + (both.ljust(point, "0") if len(both) <= point else f"{both[:point]}.{both[point:]}")
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{both}"
    return f"{sign}{both[0]}{'.' + both[1:] if len(both) > 1 else ''}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def canonical_json(text: str | None) -> str | None:
    """JSON arguments with their top-level keys in order; objects inside keep only keys that the top level has, too. Null if it is no JSON object."""
    try:
        args = json.loads(text, parse_int=float, parse_constant=lambda c: 1 / 0)
    except (TypeError, ValueError, ZeroDivisionError):
        return None
    if not isinstance(args, dict):
        return None
    order = sorted(args, key=lambda k: k.encode("utf-16-be", "surrogatepass"))

    def written(v) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{written(v[k])}" for k in order if k in v) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(written, v)) + "]"
        if isinstance(v, float):
            return js_number(v)
        return json.dumps(v, ensure_ascii=False)

    return written(args)


def cache_key(tool: Column, args: Column) -> Column:
    """Tool and 16 hex digits of the hash of its arguments' canonical JSON (args: JSON text); null where args is no JSON object."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(canonical_json)

    return F.concat(tool, F.lit(":"), F.substring(F.sha2(canonical(args), 256), 1, 16))
