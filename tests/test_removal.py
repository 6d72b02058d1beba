"""What is left works without the training-data folders, with and without the pipeline's file."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).parent.parent


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    shutil.copytree(REPO / "nodeloom", tmp_path / "nodeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (REPO / "corpus_pipeline.py").exists() else [])]:
        shutil.copy(REPO / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 80; assert not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr


def test_nothing_imports_llm():
    for path in (REPO / "nodeloom").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert not re.search(r"\bllm\b", path.read_text()), path
