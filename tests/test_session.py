"""Stored tables: written to the shared folder, and deleted from it."""

import os
import subprocess
import sys
import time
from pathlib import Path

from loam import session

ROOT = Path(__file__).resolve().parent.parent


def stored_paths(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {f for f in os.listdir(folder) if f.startswith("loam-")} if os.path.isdir(folder) else set()


def test_scratch_deletes_what_it_does_not_keep(spark):
    before = stored_paths(spark)
    with session.scratch() as inner:
        session.stored(spark.range(3), "gone")
        kept = inner.keep(session.stored(spark.range(5), "kept"))
    assert len(stored_paths(spark) - before) == 1 and kept.count() == 5
    session.discard(kept)
    assert stored_paths(spark) == before


def test_nothing_is_left_when_the_driver_ends(tmp_path):
    """Whether the session was stopped or not, and whether clear was called or not."""
    for ending in ("", "spark.stop()", "session.clear(); assert not [f for f in os.listdir(folder) if f.startswith('loam-')]; spark.stop()"):
        code = f"""
import os
from loam import session
folder = {str(tmp_path)!r}
spark = session.build_session("local[1]", 1, "1g", **{{"spark.checkpoint.dir": "file://" + folder}})
assert session.stored(spark.range(4), "a").join(session.stored(spark.range(4), "b"), "id").count() == 4
assert len([f for f in os.listdir(folder) if f.startswith('loam-')]) == 2
{ending}
"""
        run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True, timeout=120)
        assert run.returncode == 0, run.stderr[-2000:]
        for _ in range(100):  # the JVM ends a little after Python
            if left := list(tmp_path.glob("loam-*")):
                time.sleep(0.1)
        assert left == [], ending
