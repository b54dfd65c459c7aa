"""Captured logs and diffs, cut anywhere."""

import io
import random

import pytest

from lodestrata.operators import changes
from lodestrata.sources import gittext as g

SEP, FIELD = g.LOG_RECORD, g.LOG_FIELD


def _split(raw, size, sep, lined, block):
    return [r for lo in range(0, len(raw), size) for r in g.records(io.BytesIO(raw), lo, min(lo + size, len(raw)), sep, lined, block)]


@pytest.mark.parametrize("size", [1, 2, 3, 5, 9, 64, 1000])
@pytest.mark.parametrize("block", [1, 4, 1 << 20])
def test_no_cut_loses_or_doubles_a_record(size, block):
    rng = random.Random(size)
    for _ in range(25):
        raw = "".join(rng.choice(["<<<SEP>>>", "<<<", "SEP>>>", "a", "é\n", "<", ""]) for _ in range(rng.randint(0, 25))).encode()
        want, at = [], 0
        for i, part in enumerate(raw.split(b"<<<SEP>>>")):
            if i or part:
                want.append((at - 9 if i else 0, part))
            at += len(part) + 9
        assert _split(raw, size, b"<<<SEP>>>", False, block) == want
        raw = "".join(rng.choice(["\n", "diff --git ", "diff", " --git ", "x", "\ndiff --git a"]) for _ in range(rng.randint(0, 25))).encode()
        want = [p for p in ("\n" + raw.decode()).split("\ndiff --git ")[1:]]
        assert [r[1].decode() for r in _split(raw, size, b"diff --git ", True, block)] == [w + "\n" if i < len(want) - 1 else w for i, w in enumerate(want)]


def test_log_entries(spark, tmp_path):
    head = lambda *f: SEP + FIELD.join(f)
    raw = "\n".join([
        head("a1", "2025-01-02", "Ann", "feat: x"), "", "3\t1\tsrc/a.ts", "-\t-\tlogo.png", "12x\t\tp q\tr", "1\t2", "",
        head("b2", "2025-01-01", "Bob", "docs: <<<y", "z"), head("c3", "2025-01-01", "no message"), SEP, head("d4", "2024-12-31", "", ""),
    ])
    (tmp_path / "one.log").write_text(raw)
    (tmp_path / "_hidden").write_text(raw)
    for split in (1, 7, 50, 1 << 20):
        d = g.git_text(spark, str(tmp_path), "log", split)
        assert d.rdd.getNumPartitions() == -(-len(raw.encode()) // split)
        rows = {r.hash: r for r in changes.log_entries(d).collect()}
        assert set(rows) == {"a1", "b2", "d4"}
        assert [tuple(f) for f in rows["a1"].files] == [("src/a.ts", 3, 1), ("logo.png", 0, 0), ("p q\tr", 12, 0)]
        assert (rows["a1"].insertions, rows["a1"].deletions, rows["a1"].category) == (15, 1, "feat")
        assert (rows["b2"].message, rows["b2"].files, rows["b2"].category, rows["d4"].message) == ("docs: <<<y", [], "docs", "")


DIFF = """warning: before the first file
diff --git a/src/a.ts b/src/a.ts
index 1..2 100644
--- a/src/a.ts
+++ b/src/a.ts
@@ -18,9 +18,10 @@ f
 x
-old
+new
++++ three
@@ -40 +41 @@
-a
---- b
+b
diff --git a/n.py b/n.py
new file mode 100644
--- /dev/null
+++ b/n.py
@@ -0,0 +1,2 @@
+diff --git a/x b/x
+y
diff --git a/o.png b/o.png
Binary files a/o.png and b/o.png differ
diff --git a/p b/q b/q
similarity index 90%
rename from p
rename to q b/q
diff --git a/d b/d
deleted file mode 100644
@@ broken
-x
"""


def test_diff_entries(spark, tmp_path):
    (tmp_path / "x.diff").write_text(DIFF)
    want = {
        "src/a.ts": (None, False, False, False, 1 + 1, 1 + 1, [(18, 10, 1, 1), (41, 1, 1, 1)]),
        "n.py": (None, True, False, False, 2, 0, [(1, 2, 2, 0)]),
        "o.png": (None, False, False, True, 0, 0, []),
        "q b/q": ("p", False, False, False, 0, 0, []),
        "d": (None, False, True, False, 0, 1, [(0, 1, 0, 1)]),
    }
    for split in (1, 13, 100, 1 << 20):
        rows = changes.diff_entries(g.git_text(spark, str(tmp_path / "x.diff"), "diff", split)).collect()
        assert len(rows) == len(want)
        for r in rows:
            assert (r.old_path, r.is_new, r.is_deleted, r.is_binary, r.added, r.removed, [tuple(h) for h in r.hunks]) == want[r.path], r.path
    symbols = spark.createDataFrame([("src/a.ts", "f", 1, 20), ("src/a.ts", "g", 30, 40), ("src/a.ts", "h", 41, 60)], "path string, name string, start_line long, end_line long")
    hit = changes.affected_symbols(changes.entry_hunks(changes.diff_entries(g.git_text(spark, str(tmp_path), "diff"))), symbols)
    assert sorted((r.name, r.first_hunk, r.change) for r in hit.collect()) == [("f", 18, "MODIFIED"), ("h", 41, "MODIFIED")]


def test_empty_and_missing(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "empty.log").write_text("")
    assert g.git_text(spark, str(tmp_path / "none")).count() == 0
    assert changes.log_entries(g.git_text(spark, str(tmp_path / "empty.log"))).count() == 0
    with pytest.raises(Exception, match="not lgo"):
        g.git_text(spark, str(tmp_path), "lgo").count()
    with pytest.raises(Exception, match="away"):
        g.git_text(spark, str(tmp_path / "away")).count()


def test_changed_names(spark, tmp_path):
    assert g.changed_names(spark, str(tmp_path)).count() == 0
    (tmp_path / "HEAD~1").write_text("a.ts\n\nb c.ts\na.ts\n")
    assert sorted(r.path for r in g.changed_names(spark, str(tmp_path)).collect()) == ["a.ts", "b c.ts"]
    (tmp_path / "HEAD~5").write_text("x\n")
    assert [r.path for r in g.changed_names(spark, str(tmp_path)).collect()] == ["x"]
