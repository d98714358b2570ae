"""Session settings and code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def build_session(master: str = "local[*]", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter's own settings hold.

    On one machine, intermediate tables go to a temporary folder unless
    spark.checkpoint.dir names another place.
    """
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    if master.startswith("local"):
        settings.setdefault("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='loam-shared-')}")
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package, once per session.

    Nothing to do where PYTHONPATH names the package's folder already, as on a
    cluster on which it is installed.
    """
    context = spark.sparkContext
    path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(ROOT) in path or getattr(context, "_loam_shipped", False):
        return
    with tempfile.TemporaryDirectory() as folder:
        package = Path(folder, "package")
        shutil.copytree(ROOT / "loam", package / "loam", ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(f"{folder}/loam_code", "zip", package)
        kept = Path(tempfile.mkdtemp(prefix="loam-"), "loam_code.zip")
        shutil.copy(archive, kept)
    context.addPyFile(str(kept))
    context._loam_shipped = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, which every executor can read.

    Where that setting is absent on a single machine (tests, benchmarks) the
    session's warehouse serves instead; on a cluster the warehouse must then be
    more than a folder of one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        base = spark.conf.get("spark.sql.warehouse.dir")
        if not spark.sparkContext.master.startswith("local") and base.startswith(("file:", "/")):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{base.rstrip('/')}/loam-{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


#: Paths of stored tables that are still there, with their sessions.
_paths: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back; cuts lineage and survives lost executors.

    The table goes with discard, at the end of a surrounding scratch, with clear,
    or when the driver ends.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if not _paths:
        atexit.register(clear)
    _paths[path] = spark
    df.write.parquet(path, compression=compression)
    files, place = file_system(spark, path)
    files.deleteOnExit(place)  # heeded only for a path that exists
    out = spark.read.schema(df.schema).parquet(path)
    out._loam_path = path
    return out


def delete(path: str) -> None:
    """Delete a stored table, unless its session has ended: then Hadoop has done so, or will."""
    spark = _paths.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        files, place = file_system(spark, path)
        files.delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete a stored table that no later plan reads."""
    delete(df._loam_path)


def clear() -> None:
    """Delete all stored tables; no DataFrame that reads one can be used afterwards. Call it before spark.stop()."""
    for path in list(_paths):
        delete(path)


class scratch:
    """A block whose stored tables are deleted at its end, but for those given to keep."""

    def __enter__(self) -> scratch:
        self.before = set(_paths)
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.before.add(df._loam_path)
        return df

    def __exit__(self, *_: object) -> None:
        for path in [p for p in _paths if p not in self.before]:
            delete(path)
