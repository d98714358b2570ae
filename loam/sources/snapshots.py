"""A keyed table in buckets under a manifest: point writes touch only their buckets, and a failed write leaves the old table.

Layout: path/data/<write>/bucket=<n>/ holds rows, path/manifests/<version> says
for each bucket which write holds it. A write makes new folders for the buckets
it touches and then a manifest; readers see it once the manifest has its name.
Two writers of one version: the second one's manifest finds the name taken.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import file_system

#: What a change does: put a whole row, change the columns that are not null of a row that is there, take the row away.
PUT, CHANGE, REMOVE = "put", "change", "remove"


class Conflict(RuntimeError):
    """Another write has taken the version."""


class Snapshot:
    """Rows of a schema by one key column, which may not be null."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    # ---- manifests

    def versions(self) -> list[int]:
        files, place = file_system(self.spark, f"{self.path}/manifests")
        found = files.listStatus(place) if files.exists(place) else []
        names = [s.getPath().getName() for s in found]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """bucket -> folder; empty before the first write."""
        known = self.versions()
        if version is None and not known:
            return {}
        files, place = file_system(self.spark, f"{self.path}/manifests/{known[-1] if version is None else version}")
        stream = files.open(place)
        try:
            raw = bytes(stream.readAllBytes())
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(raw).items()}

    def commit(self, version: int, manifest: dict[int, str]) -> None:
        name = f"{self.path}/manifests/.{version}-{uuid.uuid4().hex}"
        files, place = file_system(self.spark, name)
        stream = files.create(place, False)
        stream.write(json.dumps(manifest, sort_keys=True).encode())
        stream.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options
        none = self.spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 0)
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(place, file_system(self.spark, f"{self.path}/manifests/{version}")[1], none)
        except Exception as e:
            files.delete(place, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} is taken") from e
            raise

    # ---- reading and writing

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (default: the last), of some buckets or all."""
        folders = sorted({f for b, f in self.manifest(version).items() if only is None or b in only})
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, changes: DataFrame) -> int:
        """Apply changes and return the new version.

        changes has op (put, change or remove), seq, which orders the changes of
        a key, the key, and any of the other columns; missing ones are null. A
        change of a row that isn't there does nothing; a removed row can be put
        again. Changes of a key in one write have the effect of their order; those
        with the same seq are taken as put, change, remove. Rows with a null key
        or another op are refused.
        """
        base = self.versions()
        version = base[-1] + 1 if base else 1
        held = self.manifest(base[-1]) if base else {}
        rest = [f for f in self.schema.fields if f.name != self.key]
        given = set(changes.columns)
        rows = changes.select("op", "seq", F.col(self.key), *[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in rest])
        legal = F.col("op").isin(PUT, CHANGE, REMOVE) & F.col(self.key).isNotNull()
        rows = rows.withColumn("_key", F.when(F.coalesce(legal, F.lit(False)), F.col(self.key)).otherwise(F.raise_error("a change without key or with an unknown op"))).drop(self.key)
        order = F.struct("seq", F.when(F.col("op") == REMOVE, 2).when(F.col("op") == CHANGE, 1).otherwise(0))
        whole = F.col("op") != CHANGE
        told = lambda f: F.max_by(F.struct(F.col(f.name).alias("value")), F.when(whole | F.col(f.name).isNotNull(), order))
        folded = rows.groupBy("_key").agg(F.max_by("op", F.when(whole, order)).alias("_last"), *[told(f).alias(f"_{f.name}") for f in rest])
        folded = folded.withColumn("_b", self.bucket(F.col("_key")))
        touched = [r["_b"] for r in folded.select("_b").distinct().collect()]  # as many as there are buckets, at most
        if not touched:
            return base[-1] if base else 0
        old = self.read(base[-1], touched) if base else self.spark.createDataFrame([], self.schema)
        met = old.withColumn("_there", F.lit(True)).join(folded, F.col(self.key) == F.col("_key"), "full_outer")
        kept = F.when(F.col("_last").isNull(), F.coalesce("_there", F.lit(False))).otherwise(F.col("_last") == PUT)
        value = lambda f: F.when(F.col(f"_{f.name}").isNotNull(), F.col(f"_{f.name}")["value"]).otherwise(F.col(f.name))
        columns = {f.name: value(f) for f in rest} | {self.key: F.coalesce(self.key, "_key")}
        new = met.where(kept).select(*[columns[f.name].alias(f.name) for f in self.schema.fields])
        folder = f"{self.path}/data/{version}-{uuid.uuid4().hex}"
        # a task or some, by size, to a bucket: few files
        new.withColumn("bucket", self.bucket(F.col(self.key))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        files, _ = file_system(self.spark, folder)
        there = lambda b: files.exists(file_system(self.spark, f"{folder}/bucket={b}")[1])
        manifest = {b: f for b, f in held.items() if b not in touched} | {b: f"{folder}/bucket={b}" for b in touched if there(b)}
        self.commit(version, manifest)
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but for the last keep, and the folders that none of those names."""
        known = self.versions()
        named = {f for v in known[-keep:] for f in self.manifest(v).values()}
        for v in known[:-keep]:
            for f in set(self.manifest(v).values()) - named:
                file_system(self.spark, f)[0].delete(file_system(self.spark, f)[1], True)
        for v in known[:-keep]:
            file_system(self.spark, self.path)[0].delete(file_system(self.spark, f"{self.path}/manifests/{v}")[1], False)


def changes(df: DataFrame, op: str, seq: Column | int = 0, **columns: Column) -> DataFrame:
    """Changes of one kind: df's columns, and those given."""
    return df.withColumns({"op": F.lit(op), "seq": (F.lit(seq) if isinstance(seq, int) else seq).cast("long")} | columns)


def acknowledged(df: DataFrame, key: str) -> DataFrame:
    """Messages of a dead-letter table (key) that are done."""
    return changes(df.select(key), REMOVE)


def requeued(df: DataFrame, key: str) -> DataFrame:
    """Messages that are tried again from the start."""
    return changes(df.select(key), CHANGE, status=F.lit("pending"), retry_count=F.lit(0))


def softly_deleted(df: DataFrame, key: str, when: Column) -> DataFrame:
    return changes(df.select(key), CHANGE, deleted_at=when)
