"""The driver contract, also without the corpus operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["sender_id", "message_count", "state", "method"] and rows.count() > 0


def test_sql_has_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_corpus_operators(tmp_path):
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    for folder in ("mailgrain", "tests"):
        shutil.copytree(f"{ROOT}/{folder}", tmp_path / folder, ignore=ignore)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op1') for k in q); e.oracle_sql()"
    # What the session's path names besides this repository stays importable (the libraries of tests may be there).
    others = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != ROOT]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *others])}

    def run(*args):
        done = subprocess.run([sys.executable, *args], cwd=tmp_path, env=env, text=True, capture_output=True, check=False)
        assert done.returncode == 0, f"{args}\n{done.stdout}\n{done.stderr}"

    run("-c", code)
    # Every other test can be collected, and the functions' tests pass.
    run("-m", "pytest", "-q", "-p", "no:cacheprovider", "--rootdir", str(tmp_path), "--collect-only", "tests")
    run("-m", "pytest", "-q", "-p", "no:cacheprovider", "--rootdir", str(tmp_path), "tests/test_functions.py")
