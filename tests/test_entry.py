"""The entry point with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOWN = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print('\\n'.join(q))"


@pytest.mark.parametrize("gone", [["cohortcast/llm"], ["cohortcast/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_queries_of_what_is_there(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    for g in gone:
        path = copy / g
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    run = subprocess.run([sys.executable, "-c", SHOWN], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    names = run.stdout.split()
    assert "field_probabilities" in names and "pipeline" not in names
    if "cohortcast/llm" in gone:
        assert not any(n.startswith("op") for n in names)
