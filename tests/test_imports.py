"""The entry points import without a session, and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_import_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout) > 100, said.stderr


def test_nothing_else_needs_the_corpus_subpackage():
    for f in (ROOT / "hydrospark").rglob("*.py"):
        if "llm" not in f.parts:
            assert "hydrospark.llm" not in f.read_text() and "corpus_pipeline" not in f.read_text(), f
