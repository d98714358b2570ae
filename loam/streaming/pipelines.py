"""Structured Streaming forms: the same transforms as batch, with watermarks, checkpoints and state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.schemas import STREAM_EVENT

c = F.col


def read_files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", most: int = 100) -> DataFrame:
    """A stream of the files that arrive under path; most bounds the files of a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most).format(kind).load(path)


def usage_by_window(events: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Counts and approximate users by event time; rows later than late are dropped."""
    e = events.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))


def routed(raw: DataFrame, known: tuple[str, ...] = ("confluence", "jira", "gitlab")) -> DataFrame:
    """Events of JSON text with a route: a known source, other, or rejected when malformed."""
    e = raw.select(c("value").alias("raw"), F.from_json("value", STREAM_EVENT).alias("e"))
    bad = c("e").isNull() | c("e.doc_id").isNull() | c("e.event_type").isNull()
    return e.select("raw", "e.*", F.when(bad, "rejected").when(c("e.source").isin(*known), c("e.source")).otherwise("other").alias("route"))


def hmac_hex(message: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a text from two hashes, inside the JVM."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in block).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "utf-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def received(requests: DataFrame, key: bytes) -> DataFrame:
    """requests (source, body, signature, ...) with computed, status, event_type and doc_id.

    status: 401 where the signature header is missing or is not that of the
    body, 422 where the body is no JSON, else 202. Event type and document come
    from the body as each source words them; "unknown" where it has none.
    """
    computed = requests.withColumn("computed", hmac_hex(c("body"), key))
    field = lambda *names: F.coalesce(*[F.get_json_object("body", f"$.{n}") for n in names])
    signed = c("signature").startswith("sha256=") & (F.substring("signature", 8, 64) == c("computed"))
    valid = F.try_parse_json("body").isNotNull()
    kind = F.when(c("source") == "gitlab", field("object_kind", "event_name")).otherwise(field("event", "event_type"))
    status = F.when(~F.coalesce(signed, F.lit(False)), 401).when(~valid, 422).otherwise(202)
    known = computed.withColumn("status", status)
    return known.withColumn("event_type", F.when(c("status") == 202, F.coalesce(kind, F.lit("unknown")))).withColumn("doc_id", F.when(c("status") == 202, F.coalesce(field("page.id", "object_attributes.id", "object_kind"), F.lit("unknown"))))


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events without redeliveries within the watermark."""
    return events.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Micro-batches of all that is there, each handled once it is complete.

    A restart repeats the batch that failed under the same number, so handle
    must overwrite, not append, what it wrote for that number.
    """
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_sink(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """An idempotent sink: batch n overwrites path/batch=n."""

    def write(df: DataFrame, n: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return write


def retried(failures: DataFrame, most: int = 3, base: float = 2.0) -> DataFrame:
    """Failed messages with their next try (seconds, exponential), dead after most retries."""
    n = c("retry_count") + 1
    later = F.when(n < most, c("now") + F.pow(F.lit(base), n))
    return failures.withColumns({"retry_count": n, "status": F.when(n >= most, "dead").otherwise("pending"), "next_retry_at": later})


def token_bucket(requests: DataFrame, rate: float, capacity: float, key: str = "user_id", forget: bool = False) -> DataFrame:
    """key, n, allowed: requests (key, t in seconds) that a bucket of capacity, refilled at rate, lets through.

    The state of a key is its tokens and the time of its last request. With
    forget, a key idle for the time that fills its bucket is dropped; that keeps
    a query alive, so a run over what is available now goes without.
    """

    def consume(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        n = allowed = 0
        for t in sorted(x for f in frames for x in f["t"].tolist()):
            tokens = capacity if last is None else min(capacity, tokens + max(0.0, t - last) * rate)
            last = t if last is None else max(t, last)
            n += 1
            if tokens >= 1:
                tokens -= 1
                allowed += 1
        state.update((float(tokens), float(last if last is not None else 0.0)))
        if forget:
            state.setTimeoutDuration(max(1, int(1000 * capacity / rate)))
        yield pd.DataFrame({key: [k[0]], "n": [n], "allowed": [allowed]})

    kind = dict(requests.dtypes)[key]
    return requests.groupBy(key).applyInPandasWithState(consume, f"{key} {kind}, n long, allowed long", "tokens double, last double", "update", GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout)
