"""The driver contract without the corpus folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
CALL = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sorted(set(q) ^ set(o)))"


def listed(folder: Path) -> str:
    out = subprocess.run([sys.executable, "-c", CALL], cwd=folder, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    return out.stdout


@pytest.mark.parametrize("keep_pipeline", [False, True])
def test_queries_without_the_corpus_folders(tmp_path, keep_pipeline):
    from ledgerlark.plans.registry import all_queries
    gone = shutil.ignore_patterns("llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(REPO / "ledgerlark", tmp_path / "ledgerlark", ignore=gone)
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (keep_pipeline and (REPO / "corpus_pipeline.py").exists()):
        shutil.copy(REPO / name, tmp_path / name)
    assert listed(tmp_path).split(maxsplit=1) == [str(len(all_queries())), "[]\n"]
