"""Life of model versions: split, automatic and manual rollback with cooldown, promotion and swap, in batch and in stream.

One step function takes a model's state from event to event. The batch form
folds a table in order, a row at a time from sorted partitions; the stream form
holds the state in Spark's store, keeps events until the watermark has passed
them, and ends a cooldown by timer. Both give the same transitions.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Samples before a canary is judged, the error rate above which it goes, seconds until the next judgement.
LEAST, MOST_ERRORS, COOLDOWN = 100, 0.05, 3600.0
#: Phase of a share of traffic, by its upper bound.
PHASES = ((0.05, "ramp_5"), (0.25, "ramp_25"), (0.5, "ramp_50"), (0.75, "ramp_75"))

EVENT = "model string, ts double, kind string, percent double, version string"
CHANGE = "model string, ts double, phase string, percent double, stable string, canary string, reason string"
FIELDS = [c.split()[0] for c in CHANGE.split(", ")]

State = dict[str, Any]


def fresh() -> State:
    return {"phase": "idle", "percent": 0.0, "ok": 0, "fail": 0, "until": 0.0, "stable": None, "previous": None, "canary": None}


def phase_of(percent: float) -> str:
    if percent <= 0:
        return "idle"
    return next((name for upto, name in PHASES if percent < upto), "full")


def roll_back(state: State, ts: float, cooldown: float) -> None:
    state.update(phase="rollback", percent=0.0, canary=None, until=ts + cooldown)


def step(state: State, ts: float, kind: str, percent: float | None, version: str | None, cooldown: float = COOLDOWN) -> str | None:
    """Apply an event to state; the reason of the transition, None where there is none.

    split: a share of traffic goes to the canary, of a new version if one is
    given (its counts begin anew); shares outside 0 to 1 are ignored. ok, fail:
    results of the canary, after each of which it is judged. promote: the canary
    becomes stable. rollback: a canary ends with a cooldown; without one the
    stable version changes places with the one before. Other kinds are ignored.
    """
    if kind == "split" and percent is not None and 0 <= percent <= 1:
        if version is not None and version != state["canary"]:
            state.update(canary=version, ok=0, fail=0)
        state.update(percent=percent, phase=phase_of(percent))
        return "split"
    if kind in ("ok", "fail"):
        state[kind] += 1
        total = state["ok"] + state["fail"]
        judged = state["phase"].startswith("ramp") and state["until"] <= ts and total >= LEAST
        if judged and state["fail"] / total > MOST_ERRORS:
            roll_back(state, ts, cooldown)
            return "errors"
    if kind == "promote" and state["canary"] is not None:
        state.update(previous=state["stable"], stable=state["canary"], canary=None, percent=1.0, phase="full")
        return "promoted"
    if kind == "rollback":
        if state["canary"] is not None:
            roll_back(state, ts, cooldown)
            return "withdrawn"
        if state["previous"] is not None:
            state.update(stable=state["previous"], previous=state["stable"])
            return "swapped"
    return None


def advanced(state: State, model: str, events: list[tuple], upto: float | None, cooldown: float) -> Iterator[tuple]:
    """Transitions of a model by events (ts, kind, percent, version), in order, with the ends of cooldowns between them.

    A cooldown ends at the latest at upto, where that is given.
    """

    def told(ts: float, reason: str) -> tuple:
        return (model, ts, state["phase"], state["percent"], state["stable"], state["canary"], reason)

    def cooled(ts: float) -> Iterator[tuple]:
        if state["phase"] == "rollback" and state["until"] <= ts:
            state["phase"] = "idle"
            yield told(state["until"], "cooled")

    for ts, kind, percent, version in events:
        yield from cooled(ts)
        if reason := step(state, ts, kind, percent, version, cooldown):
            yield told(ts, reason)
    if upto is not None:
        yield from cooled(upto)


def plain(value: Any) -> Any:
    """None for what a frame shows as missing."""
    return None if value is None or value != value else value


def key_of(event: tuple) -> tuple:
    """The order of a model's events: time, kind, percent, version; missing values first."""
    ts, kind, percent, version = event
    return ts, kind or "", -1.0 if percent is None else percent, version or ""


def transitions(events: DataFrame, cooldown: float = COOLDOWN, upto: float | None = None) -> DataFrame:
    """CHANGE rows of a table of events (EVENT; ts in seconds), models and times not null.

    Events of a model go by time, then kind, percent and version, missing ones
    first. Rows stream by in order, so a task holds one model's state, whatever
    number of events it has. Cooldowns that end after the last event end at upto
    at the latest, if it is given.
    """
    order = ["model", "ts", *[F.coalesce(c, d).asc() for c, d in (("kind", F.lit("")), ("percent", F.lit(-1.0)), ("version", F.lit("")))]]
    rows = events.where("model is not null and ts is not null").select("model", "ts", "kind", "percent", "version").repartition("model").sortWithinPartitions(*order)
    schema = pa.schema([(c, pa.float64() if c in ("ts", "percent") else pa.string()) for c in FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, state = None, fresh()
        out: list[tuple] = []
        for batch in batches:
            for own, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != model:
                    out += [] if model is None else advanced(state, model, [], upto, cooldown)
                    model, state = own, fresh()
                out += advanced(state, own, [tuple(event)], None, cooldown)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
            out = []
        if model is not None:
            out += advanced(state, model, [], upto, cooldown)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return rows.mapInArrow(run, CHANGE)


class ModelLife(StatefulProcessor):
    """transitions as a stateful operator; events wait until the watermark has passed them, so their order is that of time."""

    def __init__(self, cooldown: float = COOLDOWN):
        self.cooldown = cooldown

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        held = lambda **kinds: StructType([StructField(c, kind) for c, kind in kinds.items()])
        self.state = handle.getValueState("state", held(json=StringType()))
        self.waiting = handle.getListState("waiting", held(ts=DoubleType(), kind=StringType(), percent=DoubleType(), version=StringType()))

    def go_on(self, model: str, new: list[tuple], watermark: float) -> Iterator[pd.DataFrame]:
        events = sorted([tuple(map(plain, r)) for r in self.waiting.get()] + new, key=key_of) if self.waiting.exists() else sorted(new, key=key_of)
        due, later = [e for e in events if e[0] <= watermark], [e for e in events if e[0] > watermark]
        state = json.loads(self.state.get()[0]) if self.state.exists() else fresh()
        out = list(advanced(state, model, due, watermark, self.cooldown))
        self.state.update((json.dumps(state),))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        wake = [e[0] for e in later[:1]] + ([state["until"]] if state["phase"] == "rollback" else [])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if wake:
            self.handle.registerTimer(int(min(wake) * 1000) + 1)
        yield pd.DataFrame(out, columns=FIELDS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [tuple(map(plain, r)) for f in rows for r in f[["seconds", "kind", "percent", "version"]].itertuples(index=False)]
        yield from self.go_on(key[0], new, timerValues.getCurrentWatermarkInMs() / 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.go_on(key[0], [], timerValues.getCurrentWatermarkInMs() / 1000)

    def close(self) -> None:
        pass


def transition_stream(events: DataFrame, late: str = "10 minutes", cooldown: float = COOLDOWN) -> DataFrame:
    """transitions of a stream of EVENT rows; events later than late are dropped. Needs the RocksDB state store."""
    timed = events.where("model is not null and ts is not null").select("model", F.col("ts").alias("seconds"), "kind", "percent", "version", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")).alias("at"))
    return timed.withWatermark("at", late).groupBy("model").transformWithStateInPandas(ModelLife(cooldown), CHANGE, "Append", "EventTime")
