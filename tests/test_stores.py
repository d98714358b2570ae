"""The paged source and the bucketed snapshot store."""

import os
import random

import pytest
from pyspark.sql import functions as F

from loam.sources import paged
from loam.sources import snapshots as N


def test_pages_are_chosen_by_pushed_filters(spark, tmp_path):
    path = f"file://{tmp_path}/export"
    rows = [(i, f"2024-{i % 12 + 1:02d}-{i % 28 + 1:02d}T00:00:00", None if i % 7 == 0 else f"b{i}") for i in range(600)] + [(999, None, "no time")]
    df = spark.createDataFrame(rows, "id long, updated_at string, body string")
    paged.export_pages(df, path, rows=20)
    schema = "id long, updated_at string, body string"
    whole = paged.paged_records(spark, path, schema)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(rows, key=str)
    files = sum(f.endswith(".json") for _, _, names in os.walk(tmp_path) for f in names)
    assert whole.rdd.getNumPartitions() == files >= 31
    since = paged.paged_records(spark, path, schema, since="2024-11-05").where("id % 2 = 0")
    assert {r.id for r in since.collect()} == {i for i, t, _ in rows if t and t >= "2024-11-05" and i % 2 == 0}
    assert since.rdd.getNumPartitions() < files / 4
    physical = since._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "2024-11-05" not in physical and "% 2" in physical, physical  # the comparison is the source's, the rest Spark's
    one = whole.where("updated_at = '2024-03-03T00:00:00' and body is not null").select("body")
    assert {r.body for r in one.collect()} == {b for _, t, b in rows if t == "2024-03-03T00:00:00" and b}
    assert paged.paged_records(spark, path, schema, since="2030-01-01").count() == 0


SCHEMA = "id long, status string, n int"


def apply_by_force(table, changes):
    for op, _, key, status, n in sorted(changes, key=lambda x: (x[1], {"put": 0, "change": 1, "remove": 2}[x[0]])):
        if op == "put":
            table[key] = (status, n)
        elif op == "remove":
            table.pop(key, None)
        elif key in table:
            old = table[key]
            table[key] = (old[0] if status is None else status, old[1] if n is None else n)


def test_writes_in_any_order_of_kinds(spark, tmp_path):
    rng = random.Random(3)
    kept, want = N.Snapshot(spark, f"file://{tmp_path}/s", SCHEMA, "id", 7), {}
    assert kept.read().count() == 0
    for turn in range(4):
        seqs = {}
        batch = []
        for _ in range(60):
            key = rng.randrange(25) - 3
            seqs[key] = seqs.get(key, 0) + 1
            op = rng.choice(["put", "change", "change", "remove"])
            batch.append((op, seqs[key], key, rng.choice([None, f"s{rng.randrange(9)}"]), rng.choice([None, rng.randrange(9)])))
        rng.shuffle(batch)
        version = kept.write(spark.createDataFrame(batch, "op string, seq long, id long, status string, n int"))
        apply_by_force(want, batch)
        assert version == turn + 1 and {r.id: (r.status, r.n) for r in kept.read().collect()} == want
    old = kept.read(2).count()
    kept.vacuum(keep=3)
    assert kept.versions() == [2, 3, 4] and kept.read(2).count() == old and {r.id for r in kept.read().collect()} == set(want)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    kept = N.Snapshot(spark, f"file://{tmp_path}/s", SCHEMA, "id", 16)
    kept.write(N.changes(spark.range(200).withColumn("status", F.lit("a")), N.PUT))
    before = kept.manifest()
    kept.write(N.changes(spark.createDataFrame([(5, "b")], "id long, status string"), N.CHANGE))
    after = kept.manifest()
    assert sum(before[b] != after[b] for b in before) == 1 and kept.read().where("status = 'b'").count() == 1
    message = spark.createDataFrame([(7,)], "id long")
    kept.write(N.requeued(message, "id").drop("retry_count"))
    assert kept.read().where("id = 7").first().status == "pending"
    kept.write(N.acknowledged(message, "id"))
    assert kept.read().count() == 199
    assert kept.write(N.acknowledged(message.limit(0), "id")) == 4


def test_a_failed_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    kept = N.Snapshot(spark, f"file://{tmp_path}/s", SCHEMA, "id", 4)
    kept.write(N.changes(spark.range(20), N.PUT))
    for bad in ([("put", 1, None)], [("destroy", 1, 3)]):
        with pytest.raises(Exception, match="without key"):
            kept.write(spark.createDataFrame(bad, "op string, seq long, id long"))
    monkeypatch.setattr(N.Snapshot, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        kept.write(N.acknowledged(spark.range(10), "id"))
    monkeypatch.undo()
    assert kept.versions() == [1] and kept.read().count() == 20
    first = kept.manifest()
    kept.write(N.acknowledged(spark.range(1), "id"))
    with pytest.raises(N.Conflict):  # a second writer that read version 1
        kept.commit(2, first)
    assert kept.read().count() == 19
