"""What the driver imports, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, len(e.oracle_sql()))"


def shown(at):
    got = subprocess.run([sys.executable, "-c", SHOW], cwd=at, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert got.returncode == 0, got.stderr
    return got.stdout.split()


def test_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md"))
    whole = shown(tmp_path / "r")
    shutil.rmtree(tmp_path / "r/knotwork/llm", ignore_errors=True)
    shutil.rmtree(tmp_path / "r/tests/llm", ignore_errors=True)
    core = shown(tmp_path / "r")
    assert core[1] == "False" and int(core[0]) > 100 and int(core[2]) > 100
    (tmp_path / "r/corpus_pipeline.py").unlink(missing_ok=True)
    assert shown(tmp_path / "r") == core
    if os.path.isdir(f"{ROOT}/knotwork/llm"):
        assert whole[1] == "True" and int(whole[0]) == int(core[0]) + 11


def test_a_broken_import_is_an_error(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md"))
    if os.path.isfile(tmp_path / "r/knotwork/llm/queries.py"):
        with open(tmp_path / "r/knotwork/llm/queries.py", "a") as f:
            f.write("\nimport nothing_of_that_name\n")
        got = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path / "r", capture_output=True, text=True)
        assert got.returncode and "nothing_of_that_name" in got.stderr
