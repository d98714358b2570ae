"""Sinks: partitioned chunk files, logs, cold history, index snapshots and training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col


def write_chunks(df: DataFrame, path: str, by: str = "source_type") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def masked(value: Column) -> Column:
    """A configuration value without its middle, or without all of it where it is short."""
    return F.when(F.length(value) > 20, F.concat(F.left(value, F.lit(4)), F.lit("***"), F.right(value, F.lit(4)))).otherwise("***")


def audit_rows(df: DataFrame, kind: str, when: Column, user: Column, details: dict[str, Column], query: Column | None = None, endpoint: Column | None = None, status: Column | None = None, duration: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Rows of one kind of event in the audit log's schema; id is a hash of kind, time, user and details."""
    held = F.create_map(*[x for k, v in details.items() for x in (F.lit(k), v.cast("string"))])
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    ident = F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", F.lit(kind), text(when), text(user), *[text(v) for v in details.values()]), 256), 1, 24))
    none = lambda x, other: F.lit(other) if x is None else x
    return df.select(
        ident.alias("id"), when.cast("string").alias("timestamp"), F.lit(kind).alias("type"), user.cast("string").alias("user"), F.lit("unknown").alias("ip"),
        none(endpoint, "unknown").alias("endpoint"), (F.lit("n/a") if query is None else F.substring(F.sha2(query, 256), 1, 16)).alias("hash"), held.alias("details"),
        none(duration, 0.0).cast("double").alias("duration_ms"), none(tokens, 0).cast("long").alias("tokens_used"), none(status, "success").alias("status"),
    )


def audit_query(df: DataFrame, when: Column, user: Column, query: Column, response: Column, chunks: Column, duration: Column, tokens: Column) -> DataFrame:
    return audit_rows(df, "query", when, user, {"query_preview": F.left(query, F.lit(200)), "response_preview": F.left(response, F.lit(200)), "chunks_retrieved": chunks}, query, F.lit("/v1/chat/completions"), None, F.round(duration, 2), tokens)


def audit_denied(df: DataFrame, when: Column, user: Column, resource: Column, reason: Column) -> DataFrame:
    return audit_rows(df, "access_denied", when, user, {"resource": resource, "reason": reason}, endpoint=resource, status=F.lit("denied"))


def audit_config(df: DataFrame, when: Column, user: Column, key: Column, old: Column, new: Column) -> DataFrame:
    return audit_rows(df, "config_change", when, user, {"config_key": key, "old_value": masked(old), "new_value": masked(new)}, endpoint=F.lit("/admin/config"))


def audit_error(df: DataFrame, when: Column, user: Column, kind: Column, message: Column, stack: Column, endpoint: Column) -> DataFrame:
    return audit_rows(df, "error", when, user, {"error_type": kind, "error_message": F.left(message, F.lit(500)), "stack_trace": F.left(F.coalesce(stack, F.lit("")), F.lit(2000))}, endpoint=endpoint, status=F.lit("error"))


def audit_trace(df: DataFrame, when: Column, user: Column, query: Column, chunks: Column, scores: Column, tokens: Column, confidence: Column, duration: Column) -> DataFrame:
    """A request's trace; a confidence below one half is marked."""
    own = F.floor(F.length(query) / 4)
    known = F.size(scores) > 0
    details = {
        "query_preview": F.left(query, F.lit(200)), "chunks_retrieved": chunks, "rerank_min": F.when(known, F.round(F.array_min(scores), 4)), "rerank_max": F.when(known, F.round(F.array_max(scores), 4)),
        "rerank_avg": F.when(known, F.round(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores), 4)), "rerank_count": F.when(known, F.size(scores)), "total_tokens": tokens,
        "estimated_prompt_tokens": F.greatest(F.lit(0), tokens - own), "estimated_completion_tokens": own, "confidence_score": confidence,
    }
    status = F.when(confidence.isNull() | (confidence >= 0.5), "success").otherwise("low_confidence")
    return audit_rows(df, "trace", when, user, details, query, F.lit("/v1/chat/completions"), status, F.round(duration, 2), tokens)


def audit_auth(df: DataFrame, when: Column, user: Column, action: Column, success: Column) -> DataFrame:
    rows = audit_rows(df, "auth", when, user, {"action": action, "success": success}, endpoint=F.lit("/auth"), status=F.when(success, "success").otherwise("failure"))
    return rows.withColumn("type", F.when(F.col("details")["action"] == "login", "login").otherwise("auth"))


def append_history(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Append version rows, partitioned by a bucket of doc_id so that folders stay few."""
    df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))).write.mode("append").partitionBy("bucket").parquet(path)


def point_id(hash_column: str = "hash"):
    """A stable identifier of an index point, from its content hash, in UUID form."""
    h = F.sha1(hash_column)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def upsert_snapshot(spark: SparkSession, new: DataFrame, current: str | None, target: str, key: str = "id", order: str = "ts") -> DataFrame:
    """A new snapshot at target: rows of new replace those of the same key in current."""
    rows = new if current is None else new.unionByName(spark.read.parquet(current), allowMissingColumns=True)
    latest = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")
    latest.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def delete_points(spark: SparkSession, gone: DataFrame, current: str, target: str, key: str = "id") -> DataFrame:
    spark.read.parquet(current).join(gone.select(key), key, "left_anti").write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def training_sets(interactions: DataFrame, path: str) -> None:
    """Three JSON sets from (query, answer, rating, chunks): dialogue turns, preferences and rated chunks."""
    kept = interactions.where("query is not null and query <> ''")
    kept.where("rating = 'positive'").select("query", "answer").write.mode("overwrite").json(f"{path}/dialogues")
    kept.where("rating is not null").select("query", "answer", (c("rating") == "positive").alias("chosen")).write.mode("overwrite").json(f"{path}/preferences")
    kept.select("query", F.explode("chunks").alias("x")).select("query", "x.chunk_id", "x.relevance_score").write.mode("overwrite").json(f"{path}/rerank")
