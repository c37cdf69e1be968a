"""The library without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CHECK = """
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert len(names) > 60 and set(sql) <= set(names) and not [n for n in names if n.startswith("op") or n == "pipeline"], sorted(names)
"""


def test_rest_stands_alone(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "spatlas/llm", ignore_errors=True)
    shutil.rmtree(copy / "tests/llm", ignore_errors=True)
    for pipeline in (True, False):  # with the pipeline's file and without
        subprocess.run([sys.executable, "-c", CHECK], cwd=copy, check=True)
        if pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    used = [p for p in (copy / "spatlas").rglob("*.py") if "spatlas.llm" in p.read_text()]
    assert not used
