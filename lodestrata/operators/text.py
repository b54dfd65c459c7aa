"""Files, lines, sections and outlines of text corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.functions.exprs import token_estimate
from lodestrata.plans.spread import unbroadcast

#: Endings of code files.
CODE_EXTENSIONS = (
    "ts tsx js jsx mjs py go rs java kt kts swift cs cpp cc cxx hpp c h php rb scala dart lua sh bash sql r vue svelte pl pm ex exs groovy m proto bsl lisp lsp cl asd"
).split()
#: Lines that import, export or declare, by the endings of their files; characters of such a line that are shown.
_JS = (
    r"^\s*(import\s|const\s+\w+\s*=\s*require\s*\()",
    r"^\s*(export\s|module\.exports\s*=|exports\.\w+\s*=)",
    r"^\s*(async\s+)?(function|class|interface|type|enum)\s+\w+",
)
SUMMARY_LINES = {
    "ts tsx js jsx mjs cjs": _JS,
    "py": (r"^\s*(import\s|from\s+\S+\s+import\s)", None, r"^\s*(async\s+)?(def\s+\w+|class\s+\w+)"),
    "go": (r"^\s*import\s", None, r"^\s*(func\s|type\s+\w+\s+(struct|interface|func))"),
    "rs": (r"^\s*use\s", r"^\s*pub\s+(fn|struct|trait|enum|type|mod|const|static)\s", r"^\s*(async\s+)?(fn|struct|trait|enum|type|mod)\s+\w+"),
}
SHOWN = 140
#: Tokens of a batch of files and of one file in it, lines of a file that is cut, least rest for which anything of a file is shown, files in a batch.
BATCH_TOKENS, FILE_TOKENS, FILE_LINES, LEAST_REST, BATCH_FILES = 1400, 220, 24, 60, 20


def scan(files: DataFrame) -> DataFrame:
    """path, content hash, bytes, lines and tokens of whole files."""
    c = F.coalesce("content", F.lit(""))
    return files.select("path", F.sha2(c, 256).alias("content_hash"), F.octet_length(c).cast("long").alias("bytes"), F.size(F.split(c, "\n", -1)).cast("long").alias("n_lines"), token_estimate(c).alias("tokens"))


def lines(files: DataFrame) -> DataFrame:
    """path, line_no from 1, text; an empty last line counts, as in an editor."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("i", "text")).select("path", (F.col("i") + 1).cast("long").alias("line_no"), "text")


def read_range(ls: DataFrame, start: int, end: int) -> DataFrame:
    return ls.where(F.col("line_no").between(start, end))


def numbered(ls: DataFrame, width: int = 4) -> DataFrame:
    """Lines with their numbers padded on the left; lpad would cut longer numbers."""
    n = F.col("line_no").cast("string")
    return ls.withColumn("shown", F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.length(n))), n, F.lit(" | "), F.col("text")))


def head_tail(ls: DataFrame, head: int, tail: int) -> DataFrame:
    """The first and last lines of each file; all of a file that has no more. The files' line numbers come by a grouped count, not a window over lines."""
    n = ls.groupBy("path").agg(F.max("line_no").alias("n"))
    return unbroadcast(ls).join(unbroadcast(n), "path").where((F.col("line_no") <= head) | (F.col("line_no") > F.col("n") - tail)).select("path", "line_no", "text")


def directory_counts(files: DataFrame, depth: int = 5) -> DataFrame:
    """Code files under each directory and all above it, to a depth."""
    files = by_extension(files)
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(depth))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.where(F.col("path").contains("/")).select(F.explode(dirs).alias("dir")).groupBy("dir").agg(F.count("*").alias("n_files"))


def by_extension(files: DataFrame, extensions: list[str] = CODE_EXTENSIONS) -> DataFrame:
    e = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.where(e.isin(list(extensions)))


def markdown_sections(ls: DataFrame) -> DataFrame:
    """Headings with level and the line before the next heading of the same or a higher level. Fences are not looked at.

    The next such heading is the least of the next lines at each of the levels up to its own: one window
    per level over the same sort, not a join of headings with headings.
    """
    n = ls.groupBy("path").agg(F.max("line_no").alias("n_lines"))
    h = ls.where(F.col("text").rlike("^#{1,6} ")).select("path", "line_no", F.length(F.regexp_extract("text", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("text", "^#+ (.*)$", 1)).alias("title"))
    after = Window.partitionBy("path").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.when(F.col("level") >= k, F.min(F.when(F.col("level") == k, F.col("line_no"))).over(after)) for k in range(1, 7)]
    h = h.withColumn("next", F.least(*nexts))
    return unbroadcast(h).join(unbroadcast(n), "path").select("path", "level", "title", F.col("line_no").alias("start_line"), F.coalesce(F.col("next") - 1, F.col("n_lines")).alias("end_line"))


def yaml_sections(ls: DataFrame) -> DataFrame:
    """Keys in the first column; each ends before the next."""
    n = ls.groupBy("path").agg(F.max("line_no").alias("n_lines"))
    k = ls.where(F.col("text").rlike("^[A-Za-z_][A-Za-z0-9_.-]*:")).select("path", "line_no", F.regexp_extract("text", "^([A-Za-z0-9_.-]+)", 1).alias("key"))
    nxt = F.lead("line_no").over(Window.partitionBy("path").orderBy("line_no"))
    return unbroadcast(k.withColumn("next", nxt)).join(unbroadcast(n), "path").select("path", "key", F.col("line_no").alias("start_line"), F.coalesce(F.col("next") - 1, F.col("n_lines")).alias("end_line"))


def find_section(sections: DataFrame, name: Column | str, title: str = "title") -> DataFrame:
    """The first section of the name in each file, without regard to case, outer blanks, or leading #."""
    wanted = F.lower(F.trim(F.regexp_replace(F.lit(name) if isinstance(name, str) else name, "^#+\\s*", "")))
    hit = sections.where(F.lower(F.trim(F.col(title))) == wanted)
    return hit.groupBy("path").agg(F.min(F.struct("start_line", "end_line")).alias("s")).select("path", "s.start_line", "s.end_line")


def csv_rows(ls: DataFrame, start: int, end: int) -> DataFrame:
    """Rows start..end after the header, with the header; the count leaves out blank lines, the slice does not."""
    n = ls.groupBy("path").agg((F.count_if(F.trim("text") != "") - 1).alias("n_rows"))
    return unbroadcast(ls.where((F.col("line_no") == 1) | F.col("line_no").between(start + 1, end + 1))).join(unbroadcast(n), "path").select("path", "line_no", "text", "n_rows")


def toml_tables(ls: DataFrame) -> DataFrame:
    return ls.where(F.col("text").rlike(r"^\s*\[\[?[^\[\]]+\]\]?\s*$")).select("path", "line_no", F.regexp_extract("text", r"\[\[?([^\[\]]+)\]", 1).alias("name"))


def code_blocks(ls: DataFrame) -> DataFrame:
    """Pairs of fences in each file."""
    g = ls.where(F.col("text").startswith("```")).groupBy("path").agg(F.count("*").alias("f"))
    return g.select("path", F.floor(F.col("f") / 2).cast("long").alias("blocks"))


def regex_summary(ls: DataFrame) -> DataFrame:
    """Lines that import, export or declare, first rule first, by the language of the file's ending; long ones are cut. Files of other endings have none."""
    t, ending = F.col("text"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(F.lit(False), "")
    for ends, rules in SUMMARY_LINES.items():
        for name, rule in zip(("import", "export", "declaration"), rules, strict=True):
            if rule:
                kind = kind.when(ending.isin(ends.split()) & t.rlike(rule), name)
    short = F.trim(F.regexp_replace(t, r"^\s+|\s+$", ""))
    short = F.when(F.length(short) <= SHOWN, short).otherwise(F.concat(F.left(short, F.lit(SHOWN - 1)), F.lit("…")))
    return ls.withColumn("kind", kind).where("kind is not null").select("path", "line_no", "kind", short.alias("text"))


def tiered(tiers: list[DataFrame]) -> DataFrame:
    """For each path the rows of the first tier that has any."""
    every = tiers[0].withColumn("tier", F.lit(0))
    for k, d in enumerate(tiers[1:], 1):
        every = every.unionByName(d.withColumn("tier", F.lit(k)))
    first = F.min("tier").over(Window.partitionBy("path"))  # the tiers are made once
    return every.withColumn("_first", first).where("tier = _first").drop("_first")


def marked_lines(ls: DataFrame) -> DataFrame:
    """Lines with a task mark in capitals."""
    kind = F.regexp_extract("text", r"\b(TODO|FIXME|HACK|XXX|NOTE|WARNING|WARN)\b", 1)
    return ls.select("path", "line_no", kind.alias("kind"), F.trim("text").alias("text")).where("kind <> ''")


def small_large(files: DataFrame, small: int, ratio: float = 0.7) -> DataFrame:
    """How a file is read: whole if short or if its outline saves too little, else as an outline. The outline's tokens are estimated from the first 40 characters of each line, as the tables hold no code."""
    s = scan(files)
    o = files.select("path", token_estimate(F.array_join(F.transform(F.split("content", "\n", -1), lambda x: F.left(x, F.lit(40))), "\n")).alias("outline_tokens"))
    how = F.when(F.col("n_lines") <= small, "whole").when(F.col("outline_tokens") >= ratio * F.col("tokens"), "whole_by_ratio").otherwise("outline")
    return s.join(o, "path").select("path", "n_lines", "tokens", "outline_tokens", how.alias("how"))


def token_budget(files: DataFrame, budget: int = BATCH_TOKENS, per_file: int = FILE_TOKENS) -> DataFrame:
    """How each file of a batch (batch, path, content) is shown, and its tokens: what a file gets depends on what those before it left.

    A file stays whole if it fits its own limit and the rest; else it is cut to its first lines and a note; once
    no more than LEAST_REST is left, a note is all. Files go by path, a path counts once, and a batch of more than
    BATCH_FILES paths is refused: it gives no rows.
    """
    f = files.select("batch", "path", F.coalesce("content", F.lit("")).alias("content")).dropDuplicates(["batch", "path"])
    sizes = f.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") <= BATCH_FILES).select("batch")
    note = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    head = F.array_join(F.slice(F.split("content", "\n", -1), 1, FILE_LINES), "\n")
    cut = note(head, '\n\n... compacted for batch mode. Use smart_read("', F.col("path"), '") for full detail.')
    stub = note("FILE: ", F.col("path"), '\n(compacted in batch mode — use smart_read("', F.col("path"), '") for full detail)')
    f = f.join(sizes, "batch").select("batch", F.struct("path", token_estimate(F.col("content")).alias("whole"), token_estimate(cut).alias("cut"), token_estimate(stub).alias("stub")).alias("x"))
    one = f.groupBy("batch").agg(F.sort_array(F.collect_list("x")).alias("f"))  # three numbers for each of BATCH_FILES files at most
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<path:string,shown:string,given:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        shown = F.when(a["left"] <= LEAST_REST, "stub").when(x["whole"] <= F.least(F.lit(per_file), a["left"]), "whole").otherwise("cut")
        give = F.when(shown == "stub", x["stub"]).when(shown == "whole", x["whole"]).otherwise(x["cut"]).cast("long")
        return F.struct(F.greatest(F.lit(0), a["left"] - give).cast("long").alias("left"), F.concat(a["out"], F.array(F.struct(x["path"].alias("path"), shown.alias("shown"), give.alias("given")))).alias("out"))

    return one.select("batch", F.explode(F.aggregate("f", start, step)["out"]).alias("o")).select("batch", "o.path", "o.shown", "o.given")


def transcript_tokens(turns: DataFrame) -> DataFrame:
    """Per conversation: the sum of output tokens of its assistant, else the last total."""
    g = turns.groupBy("conv_id").agg(F.sum("output_tokens").alias("s"), F.max_by("total_tokens", "turn").alias("last"))
    return g.select("conv_id", F.coalesce("s", "last").cast("long").alias("tokens"))
