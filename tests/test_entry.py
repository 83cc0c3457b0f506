"""The driver's entry: importable without a session, and without the subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len([n for n in q if n.startswith('op')]), 'pipeline' in q, 'cosine_holdouts' in q)"


def show(folder) -> list[str]:
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    """Only the two folders are gone; the pipeline's module may be there still."""
    skipped = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skipped)
    for folder in ("sensegauge/llm", "tests/llm"):
        shutil.rmtree(tmp_path / "repo" / folder, ignore_errors=True)
    if not pipeline:
        (tmp_path / "repo/corpus_pipeline.py").unlink(missing_ok=True)
    assert show(tmp_path / "repo") == ["0", "False", "True"]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "sensegauge").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "sensegauge.llm" not in path.read_text(), path


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_flagship(spark):
    import __spark_entry__

    assert {r["kind"]: r["ratio_a"] for r in __spark_entry__.entry(spark).collect()}["same_sentence"] == 100.0
