"""The driver's contract: names, oracles, and life without the subpackage for training text."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_oracles():
    import __spark_entry__ as entry

    names, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(names) and len(oracles) > 200


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def without(tmp_path, *names):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *names))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(n.startswith('op1_') for n in e.queries()))"
    run = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return copy, run.stdout.split()


def test_without_training_subpackage(tmp_path):
    """With and without corpus_pipeline.py beside the missing folders, everything else loads."""
    _, both = without(tmp_path / "a", "llm", "corpus_pipeline.py")
    copy, folders = without(tmp_path / "b", "llm")
    assert both == folders and both[2:] == ["False", "False"] and int(both[0]) > 280
    run = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and "tests/llm" not in run.stdout, run.stdout + run.stderr
