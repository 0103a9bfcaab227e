"""The driver contract, with and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.ROOT)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_corpus_operators(tmp_path):
    for p in ROOT.rglob("*.py"):
        at = p.relative_to(ROOT)
        if "llm" in at.parts or at.name == "corpus_pipeline.py" or at.parts[0] in ("tests", ".git"):
            continue
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
