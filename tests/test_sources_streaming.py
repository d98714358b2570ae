"""Readers, sinks and streams: streams give what the batch gives, restarts and redeliveries included."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loam.sources import readers, sinks
from loam.streaming import pipelines


def texts(spark, values, name="raw"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_families(spark):
    page = {"id": "1", "title": "T", "space": {"key": "ENG"}, "version": {"number": 2, "when": "2024-01-02", "by": {"displayName": "A"}}, "body": {"storage": {"value": "<p>Hi &amp; bye</p><script>x</script>"}}}
    row = readers.wiki_pages(texts(spark, [json.dumps(page), "{broken", "{}"])).collect()
    assert [(r.source_id, r.content, r.metadata["version"]) for r in row] == [("1", "Hi & bye", "2")]
    issue = {"key": "P-1", "fields": {"summary": "s", "description": "d", "comment": {"comments": [{"author": {"displayName": "B"}, "body": "c"}]}}}
    assert readers.issues(texts(spark, [json.dumps(issue), json.dumps({"key": "P-2", "fields": {"summary": "x"}})])).select("content").collect()[0][0] == "d\n\nB: c"
    commit = {"id": "h", "title": "t", "message": "m", "diffs": [{"new_path": "f", "diff": "z" * 500}] * 7}
    assert readers.commits(texts(spark, [json.dumps(commit)])).first().content.count("z") == 1000


def test_chats(spark):
    listed = {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}
    mapped = {"mapping": {"y": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["2"]}, "create_time": 2.0}}, "x": {"message": {"author": {"role": "user"}, "content": {"parts": ["1"]}, "create_time": 1.0}}}}
    got = [(r.role, r.text) for r in readers.conversations(texts(spark, [json.dumps(listed), json.dumps(mapped), "Q: why\nA: so\nand so"])).orderBy("conversation", "turn").collect()]
    assert got == [("user", "a"), ("assistant", "b"), ("user", "1"), ("assistant", "2"), ("user", "why"), ("assistant", "so\nand so")]


def test_eval_set_and_log(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('# c\n\n{"query": "q", "relevant_docs": ["d"]}\nbroken\n[{"query": "r", "relevant_docs": []}, {"query": "s"}]\n')
    assert [(r.query, r.relevant_docs) for r in readers.eval_set(spark, str(tmp_path / "e.jsonl")).collect()] == [("q", ["d"]), ("r", [])]
    (tmp_path / "l.json").write_text('{"id": "1", "timestamp": "2"}\nnope\n{"id": "2", "timestamp": "3"}\n')
    assert [r.id for r in readers.log(spark, str(tmp_path / "l.json"), latest=1).collect()] == ["2"]


def test_snapshot_upsert_and_delete(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (2, 2, "z")], "id long, ts long, v string")
    sinks.upsert_snapshot(spark, a, None, f"{tmp_path}/1")
    b = sinks.upsert_snapshot(spark, spark.createDataFrame([(1, 5, "n")], "id long, ts long, v string"), f"{tmp_path}/1", f"{tmp_path}/2")
    assert sorted((r.id, r.v) for r in b.collect()) == [(1, "n"), (2, "z")]
    assert [r.id for r in sinks.delete_points(spark, b.where("id = 2"), f"{tmp_path}/2", f"{tmp_path}/3").collect()] == [1]


def test_stream_usage_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = pipelines.read_files(spark, f"{tmp_path}/in", batch.schema.simpleString()[7:-1].replace(":", " "), most=2)
    out = pipelines.usage_by_window(stream, late="60 days")
    q = out.writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    got = {(r.w.start, r.event_type): r.n for r in spark.table("usage").collect()}
    assert got == {(r.w.start, r.event_type): r.n for r in pipelines.usage_by_window(batch, late="60 days").collect()}


def test_batches_are_idempotent_and_restart(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/in")
    read = lambda: pipelines.read_files(spark, f"{tmp_path}/in", "id long", most=1)
    failed = []

    def flaky(df, n):
        pipelines.batch_sink(f"{tmp_path}/out")(df, n)
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("lost after the write")

    try:
        pipelines.run_batches(read(), flaky, f"{tmp_path}/c").awaitTermination(60)
    except Exception:
        pass
    pipelines.run_batches(read(), flaky, f"{tmp_path}/c").awaitTermination(60)
    assert failed and sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(30))


def test_routing_and_retries(spark):
    ok = {"source": "jira", "event_type": "u", "doc_id": "1", "timestamp": "t", "payload": "{}"}
    rows = pipelines.routed(texts(spark, [json.dumps(ok), json.dumps(ok | {"source": "zzz"}), "{bad", json.dumps({"source": "jira"})], "value"))
    assert [r.route for r in rows.collect()] == ["jira", "other", "rejected", "rejected"]
    df = spark.createDataFrame([(0, 10.0), (2, 10.0)], "retry_count int, now double")
    assert [(r.status, r.next_retry_at) for r in pipelines.retried(df).collect()] == [("pending", 12.0), ("dead", None)]


def test_duplicates_and_bucket(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i % 4, start + timedelta(seconds=i)) for i in range(8)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = pipelines.once(pipelines.read_files(spark, f"{tmp_path}/e", "event_id long, ts timestamp"))
    q = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 4
    spark.createDataFrame([("a", float(i) / 10) for i in range(10)] + [("b", 0.0), ("b", 9.0)], "user_id string, t double").coalesce(1).write.parquet(f"{tmp_path}/r")
    limited = pipelines.token_bucket(pipelines.read_files(spark, f"{tmp_path}/r", "user_id string, t double"), rate=1.0, capacity=3.0)
    q = limited.writeStream.outputMode("update").format("memory").queryName("bucket").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    q.awaitTermination(60)
    assert {r.user_id: (r.n, r.allowed) for r in spark.table("bucket").collect()} == {"a": (10, 3), "b": (2, 2)}


def test_sessions(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, start), (1, start + timedelta(minutes=29)), (1, start + timedelta(minutes=70)), (2, start)], "user_id long, ts timestamp")
    assert sorted((r.user_id, r.n) for r in pipelines.sessions(df).select("user_id", F.col("n")).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_shared_tables_need_a_shared_place(spark):
    """On a cluster a folder of one machine is refused; a stored table can be read until it is discarded."""
    from types import SimpleNamespace

    from loam import session

    def cluster(base, checkpoint=None):
        values = {"spark.checkpoint.dir": checkpoint, "spark.sql.warehouse.dir": base}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: values.get(k) or d), sparkContext=SimpleNamespace(master="spark://host:7077"), _jvm=spark._jvm, _jsc=spark._jsc)

    for base in ("file:/tmp/x", "/tmp/x"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(cluster(base), "t")
    assert session.shared_dir(cluster("/tmp/x", "file:///tmp/shared-of-all"), "t").startswith("file:///tmp/shared-of-all/loam-t-")
    kept = session.stored(spark.range(5), "t")
    assert kept.count() == 5
    session.discard(kept)
    with pytest.raises(Exception, match="(?i)does not exist|FILE_NOT_EXIST|FileNotFound"):
        kept.count()


def test_webhooks(spark):
    import hashlib
    import hmac

    from loam.streaming import pipelines

    body = '{"object_kind": "push", "object_attributes": {"id": 7}}'
    good = "sha256=" + hmac.new(b"k" * 70, body.encode(), hashlib.sha256).hexdigest()
    rows = [("gitlab", body, good), ("gitlab", body, good[:-1] + "x"), ("gitlab", body, None), ("confluence", body, good), ("gitlab", body, good.removeprefix("sha256="))]
    out = pipelines.received(spark.createDataFrame(rows, "source string, body string, signature string"), b"k" * 70).collect()
    assert [(r.status, r.event_type, r.doc_id) for r in out] == [(202, "push", "7"), (401, None, None), (401, None, None), (202, "unknown", "7"), (401, None, None)]


def test_audit_rows(spark, tmp_path):
    from loam.sources import readers, sinks

    c = F.col
    df = spark.createDataFrame([("2024-01-01", "u", "q" * 300, "short", "a long secret value of it", [0.25, 0.5], 0.4)], "ts string, u string, q string, old string, new string, s array<double>, p double")
    [row] = sinks.audit_config(df, c("ts"), c("u"), F.lit("k"), c("old"), c("new")).collect()
    assert row.details == {"config_key": "k", "old_value": "***", "new_value": "a lo***f it"} and row.hash == "n/a" and row.status == "success"
    path = f"{tmp_path}/log"
    sinks.append_log(sinks.audit_trace(df, c("ts"), c("u"), c("q"), F.lit(2), c("s"), F.lit(500), c("p"), F.lit(1.234)), path)
    sinks.append_log(sinks.audit_query(df, c("ts"), c("u"), c("q"), c("new"), F.lit(1), F.lit(2.0), F.lit(9)), path)
    trace, query = readers.log(spark, path).orderBy(F.desc("type")).collect()
    assert trace.status == "low_confidence" and trace.duration_ms == 1.23 and trace.details["rerank_avg"] == "0.375" and trace.details["estimated_prompt_tokens"] == "425"
    assert len(query.details["query_preview"]) == 200 and query.tokens_used == 9 and len(query.hash) == 16
