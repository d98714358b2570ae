"""Incremental, versioned storage as set operations on (doc_id, hash) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import version_key


def changes(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks added to, or gone from, each document that new speaks of: doc_id, hash, change."""
    keys = ["doc_id", "hash"]
    added = new.select(keys).distinct().join(stored.select(keys), keys, "left_anti").withColumn("change", F.lit("added"))
    touched = stored.select(keys).distinct().join(new.select("doc_id").distinct(), "doc_id", "left_semi")
    return added.unionByName(touched.join(new.select(keys), keys, "left_anti").withColumn("change", F.lit("deleted")))


def last_rows(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The n rows of each key that come first in order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def resolve(df: DataFrame, requested: str | None = None, mode: str = "first") -> DataFrame:
    """Chunks of one version of each source (source_id, version, pos).

    A requested version wins where a source has it; else the greatest, by the
    numbers in it: the first such chunk, or with mode "all" every one.
    """
    w = Window.partitionBy("source_id")
    key = version_key(F.col("version"))
    has = F.max(F.coalesce(F.col("version") == F.lit(requested), F.lit(False))).over(w) if requested else F.lit(False)
    marked = df.withColumn("_has", has).withColumn("_key", key)
    marked = marked.withColumn("_r", F.row_number().over(w.orderBy(F.desc("_key"), "pos"))).withColumn("_top", F.max("_key").over(w))
    newest = F.col("_r") == 1 if mode == "first" else F.col("_key") == F.col("_top")
    keep = F.when(F.col("_has"), F.coalesce(F.col("version") == F.lit(requested), F.lit(False))).otherwise(newest)
    return marked.where(keep).drop("_has", "_key", "_r", "_top")


def as_of(history: DataFrame, moment: Column, legacy: bool = False) -> DataFrame:
    """Chunks present at a moment, from rows (doc_id, hash, ts, operation).

    The last operation of each chunk decides. legacy: the first upsert of each
    chunk, deletes ignored.
    """
    past = history.where(F.col("ts") <= moment)
    w = Window.partitionBy("doc_id", "hash")
    if legacy:
        return past.where("operation = 'upsert'").withColumn("_r", F.row_number().over(w.orderBy("ts"))).where("_r = 1").drop("_r")
    return past.withColumn("_r", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("operation")))).where("_r = 1 and operation = 'upsert'").drop("_r")


def upsert(base: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the latest of each key."""
    return last_rows(base.unionByName(more), key, [F.desc(order)], 1)


def save_checkpoints(updates: DataFrame, path: str, run: int) -> None:
    """Append (pipeline, key, value) of a run to the state table at path; a run that is repeated overwrites its own part."""
    updates.select("pipeline", "key", F.col("value").cast("string").alias("value"), F.lit(run).alias("run")).write.mode("overwrite").parquet(f"{path}/run={run}")


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """pipeline, key, value: the latest value of each key that any run has stored."""
    rows = spark.read.schema("pipeline string, key string, value string, run int").parquet(path)
    return rows.groupBy("pipeline", "key").agg(F.max_by("value", "run").alias("value"))


def since_checkpoint(rows: DataFrame, state: DataFrame, pipeline: str, id_column: str) -> DataFrame:
    """Rows of each pipeline behind its stored last_id; all rows of a pipeline that has none."""
    last = state.where("key = 'last_id'").select(F.col("pipeline").alias(pipeline), F.col("value").cast("long").alias("_last"))
    return rows.join(last, pipeline, "left").where(F.col("_last").isNull() | (F.col(id_column) > F.col("_last"))).drop("_last")


def packed_by_key(chunks: DataFrame) -> DataFrame:
    """key, n, text, hash, keywords, questions, first: chunks (key, position, text, keywords, questions) of one key as one.

    Texts in order of position behind one another with a rule between, keywords
    each once and sorted, the first five questions. A chunk without a key stays
    alone under its hash. A key's chunks are a packed chunk in the end, so they
    are gathered.
    """
    key = F.coalesce(F.nullif("key", F.lit("")), F.concat(F.lit("_unique_"), F.sha2("text", 256)))
    rows = chunks.select(key.alias("key"), F.struct("position", "text", "keywords", "questions").alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("x"))
    rows = rows.withColumn("text", F.array_join(F.transform("x", lambda x: x["text"]), "\n\n---\n\n"))
    union = F.array_sort(F.array_distinct(F.flatten(F.transform("x", lambda x: x["keywords"]))))
    asked = F.slice(F.flatten(F.transform("x", lambda x: x["questions"])), 1, 5)
    return rows.select("key", F.size("x").cast("long").alias("n"), "text", F.sha2("text", 256).alias("hash"), union.alias("keywords"), asked.alias("questions"), F.col("x")[0]["position"].alias("first"))


def first_of(df: DataFrame, same: Column, order: str) -> DataFrame:
    """The first row of those that are the same, by order; partial aggregates, so a hot value costs one row a task."""
    names = df.columns
    return df.groupBy(same.alias("_same")).agg(F.min_by(F.struct(*names), order).alias("_x")).select("_x.*")


def newest_of(df: DataFrame, source: Column, version: Column, order: str) -> DataFrame:
    """One row of each source: that of the greatest version, the first of them by order."""
    return df.groupBy(source.alias("_source")).agg(F.min_by(F.struct(*df.columns), F.struct((-version).alias("v"), F.col(order))).alias("_x")).select("_x.*")


def version_events(df: DataFrame, key: str, version: str) -> DataFrame:
    """key, old_version, new_version and event (indexed, updated): a row for each version of each document, in order."""
    before = F.lag(version).over(Window.partitionBy(key).orderBy(version))
    rows = df.select(key, before.alias("old_version"), F.col(version).alias("new_version"))
    return rows.withColumn("event", F.when(F.col("old_version").isNull(), "indexed").otherwise("updated"))


def merged_entities(df: DataFrame) -> DataFrame:
    """id and properties of entities (id, seq, properties map): of each property the last value by seq."""
    each = df.select("id", "seq", F.explode("properties").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    return each.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))


def first_relations(df: DataFrame, order: str, keys: tuple[str, ...] = ("source", "target", "type")) -> DataFrame:
    """Of relations that are equal in keys the first by order."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_x")).select("_x.*")
