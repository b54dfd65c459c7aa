"""The library stands without its corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_nothing_else_imports_the_corpus_operators():
    for p in (ROOT / "lodestrata").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lodestrata.llm" not in p.read_text(), p


def test_entry_works_without_them(tmp_path):
    import shutil

    shutil.copytree(ROOT / "lodestrata", tmp_path / "lodestrata", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'd10_tool_audit' in e.queries() and not any(n.startswith('op') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
