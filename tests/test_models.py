"""Model states: golden steps, batch against a plain loop, and the stream against the batch."""

import random

import pytest

from loam.streaming import models as M


def test_golden_steps():
    s = M.fresh()
    assert M.step(s, 0, "split", 1.5, "v1") is None and M.step(s, 0, "promote", None, None) is None
    assert M.step(s, 1, "split", 0.1, "v1") == "split" and s["phase"] == "ramp_25"
    for i in range(94):
        assert M.step(s, 2 + i, "ok", None, None) is None
    assert [M.step(s, 100, "fail", None, None) for _ in range(6)] == [None] * 5 + ["errors"]  # 6 of 100
    assert s["phase"] == "rollback" and s["until"] == 3700 and s["canary"] is None
    assert M.step(s, 200, "split", 0.3, "v2") == "split" and (s["ok"], s["fail"]) == (0, 0)
    assert all(M.step(s, 300, "fail", None, None) is None for _ in range(150))  # still cooling
    assert M.step(s, 3700, "fail", None, None) == "errors"
    assert M.step(s, 9000, "split", 0.5, "v3") == "split" and M.step(s, 9001, "promote", None, None) == "promoted"
    assert M.step(s, 9002, "split", 0.2, "v4") == "split" and M.step(s, 9003, "promote", None, None) == "promoted"
    assert (s["stable"], s["previous"], s["phase"]) == ("v4", "v3", "full")
    assert M.step(s, 9004, "rollback", None, None) == "swapped" and (s["stable"], s["previous"]) == ("v3", "v4")
    assert M.step(s, 9005, "split", 0.2, "v5") == "split" and M.step(s, 9006, "rollback", None, None) == "withdrawn"


def some_events(seed=5, n=6000):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        kind = rng.choices(["ok", "fail", "split", "promote", "rollback", "other"], [60, 8, 1.2, 0.25, 0.15, 0.4])[0]
        out.append((f"m{min(3, int(rng.expovariate(1)))}", float(rng.randrange(60_000)), kind, rng.random() if kind == "split" else None, f"v{rng.randrange(50)}" if kind == "split" else None))
    return sorted(out, key=lambda e: e[1])


def folded(events, upto=None):
    by_model = {}
    for model, *event in events:
        by_model.setdefault(model, []).append(tuple(event))
    return sorted(t for m, own in by_model.items() for t in M.advanced(M.fresh(), m, sorted(own, key=M.key_of), upto, 1800.0))


def rows_of(df):
    return sorted(tuple(r[c] for c in M.FIELDS) for r in df.collect())


@pytest.mark.parametrize("upto", [None, 99_999.0])
def test_batch_fold(spark, upto):
    events = some_events()
    df = spark.createDataFrame(events + [(None, 1.0, "ok", None, None), ("m0", None, "ok", None, None)], M.EVENT).repartition(5)
    got = rows_of(M.transitions(df, 1800.0, upto))
    assert got == folded(events, upto) and {r[-1] for r in got} >= {"split", "errors", "promoted", "cooled", "withdrawn"}
    assert M.transitions(df.limit(0)).count() == 0


def test_stream_and_batch_agree(spark, tmp_path):
    """Events in files, some out of order within the watermark; one far behind it is dropped."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(1)
    events = some_events(n=2400)
    shuffled = sorted(events, key=lambda e: e[1] + rng.uniform(-250, 250))
    parts = [shuffled[i : i + 600] for i in range(0, 2400, 600)]
    parts.append([("m0", 10.0, "split", 0.9, "too late"), ("end", 200_000.0, "ok", None, None)])
    parts.append([("end", 300_000.0, "ok", None, None)])
    for i, part in enumerate(parts):
        spark.createDataFrame(part, M.EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(M.EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    out = M.transition_stream(stream, "10 minutes", 1800.0)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows_of(spark.read.parquet(f"{tmp_path}/out"))
    assert got == [r for r in folded(events, 199_000.0)] and "too late" not in str(got)
