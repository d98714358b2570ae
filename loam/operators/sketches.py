"""Counters of bounded size: the most frequent items of any number of rows."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH = "item string, n long, error long, least long"
SCHEMA = pa.schema([("item", pa.string()), ("n", pa.int64()), ("error", pa.int64()), ("least", pa.int64())])
#: Sketches that one task merges at once.
FAN = 64


def mentions(text: Column) -> Column:
    """Names in a text, each as often as it is there: words of more than two characters, marks at their ends aside, that begin with a capital or hold '_' or '-'."""
    marks = r"^[.,;:!?()\[\]{}'\"]+|[.,;:!?()\[\]{}'\"]+$"
    bare = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, marks, ""))
    return F.filter(bare, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}|[_-]"))


class SpaceSaving:
    """At most size counters; an item without one takes that of the least frequent, and its count as error."""

    def __init__(self, size: int):
        self.size = size
        self.held: dict[str, list[int]] = {}
        self.heap: list[tuple[int, str]] = []

    def add(self, item: str, times: int = 1) -> None:
        if item in self.held:
            self.held[item][0] += times
            return
        error = 0
        if len(self.held) >= self.size:
            while True:  # counts in the heap may be behind; the first that is up to date is the least
                n, other = heappop(self.heap)
                now = self.held[other][0]
                if n == now:
                    break
                heappush(self.heap, (now, other))
            error = self.held.pop(other)[0]
        self.held[item] = [error + times, error]
        heappush(self.heap, (error + times, item))

    def least(self) -> int:
        """What an item without a counter can have been counted at most."""
        return min((n for n, _ in self.held.values()), default=0) if len(self.held) >= self.size else 0

    def rows(self) -> list[tuple[str, int, int, int]]:
        least = self.least()
        return [(item, n, error, least) for item, (n, error) in self.held.items()]


def merged(sketches: list[list[tuple[str, int, int, int]]], size: int) -> list[tuple[str, int, int, int]]:
    """One sketch of several: a counter that one of them lacks counts as its least, as count and as error."""
    leasts = [rows[0][3] if rows else 0 for rows in sketches]
    total: dict[str, list[int]] = {}
    for least, rows in zip(leasts, sketches, strict=True):
        for item, n, error, _ in rows:
            own = total.setdefault(item, [sum(leasts), sum(leasts)])
            own[0] += n - least
            own[1] += error - least
    kept = sorted(((n, item, error) for item, (n, error) in total.items()), key=lambda x: (-x[0], x[1]))
    least = max(sum(leasts), kept[size][0] if len(kept) > size else 0)
    return [(item, n, error, least) for n, item, error in kept[:size]]


def frequent(items: DataFrame, size: int = 500) -> DataFrame:
    """item, n, error, least: a Space-Saving sketch of a table with one string column, null left out.

    n is at least an item's true count and n - error at most; an item that is not
    in the sketch was counted least times at most, and least is no more than rows
    / size. Each task keeps size counters; their sketches are merged FAN by FAN
    in a tree, so no task sees more than FAN * size rows. Which of equally rare
    items stay hangs on how the rows are dealt; the bounds hold in any case.
    """
    column = items.columns[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = SpaceSaving(size)
        for batch in batches:
            for pair in batch.column(0).value_counts().to_pylist():
                sketch.add(pair["values"], pair["counts"])
        rows = sketch.rows()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    source = items.where(F.col(column).isNotNull()).select(F.col(column).cast("string"))
    tasks = source.rdd.getNumPartitions()
    sketches = source.mapInArrow(count, SKETCH).withColumn("part", F.spark_partition_id())
    while True:
        tasks = -(-tasks // FAN)
        sketches = sketches.withColumn("group", F.floor(F.col("part") / FAN).cast("int"))

        def merge(t: pa.Table) -> pa.Table:
            own: dict[int, list] = {}
            for r in t.to_pylist():
                own.setdefault(r["part"], []).append((r["item"], r["n"], r["error"], r["least"]))
            rows = merged(list(own.values()), size)
            columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)]
            return pa.table([*columns, pa.array([t.column("group")[0].as_py()] * len(rows), pa.int32())], names=[*SCHEMA.names, "part"])

        sketches = sketches.groupBy("group").applyInArrow(merge, SKETCH + ", part int")
        if tasks <= 1:
            return sketches.drop("part")
