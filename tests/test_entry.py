"""The entry point with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
sys.modules["newsprint.llm"] = None
import __spark_entry__ as e
assert e.llm is None and len(e.queries()) > 100 and not any(q.startswith("op") for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_imports_without_corpus_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "total_pages" in df.columns


def test_corpus_operators_stay_apart():
    for path in (ROOT / "newsprint").rglob("*.py"):
        if "llm" not in path.parts:
            assert "newsprint.llm" not in path.read_text()
