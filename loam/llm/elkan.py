"""Operator 12: product quantisation of vectors by Elkan's form of Lloyd's method.

A row of the state is a block of vectors: each part of each vector with its
entry, an upper bound of the distance to it and a lower bound of the distance to
every entry of its codebook, one byte each. The state is a stored table; a round reads it,
skips what the bounds rule out, and writes it again with the sums that the new
entries need. No row is ever shuffled. What travels to the driver and back, the
codebooks, has 64 times a vector's length numbers, whatever the data.

Bounds are distances, rounded outwards; a distance that decides anything is
compared as a whole number, squared. An entry is skipped only where a bound is
strictly larger, so ties always meet, and go to the lower index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

from ..session import ship_code
from .common import discard, joined_by_weight, release, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors in a block of the state.
BLOCK = 1024
#: Rounding of bounds: far beyond the error of a few floating-point steps.
SLACK = 1e-9

STATE = "vectors binary, codes binary, upper binary, lower binary, top double, sums binary, counts binary, measured long"


def quantised(df: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label and q (array<long>, floor(256 * x)) of usable rows, and the length of q (0: none is usable).

    Usable are vectors without null or non-finite components whose length is
    that of the usable vector with the smallest vec_id and a multiple of parts,
    not 0. Components beyond what keeps a sum of squares exact are cut to it.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = df.where(F.coalesce(sound, F.lit(False)))
    length = kept.select("vec_id", F.size(x).alias("n")).agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "n"))["n"].alias("n")).first()["n"] or 0
    most = math.isqrt((1 << 61) // max(1, length)) // 2
    whole = F.transform(x, lambda v: F.greatest(F.lit(-most).cast("long"), F.least(F.lit(most).cast("long"), F.floor(F.greatest(F.lit(-1e17), F.least(F.lit(1e17), v.cast("double") * SCALE))))))
    return kept.where(F.size(x) == length).select("vec_id", "label", whole.alias("q")), length


def first_codebooks(vectors: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors of the smallest vec_ids, ascending: parts x entries x width."""
    ids = vectors.where("vec_id is not null").groupBy("vec_id").agg(F.min("q").alias("q")).orderBy("vec_id").limit(entries)
    rows = np.array([r.q for r in ids.collect()], np.int64).reshape(-1, length)
    return np.ascontiguousarray(rows.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    d = x - entry
    return (d * d).sum(axis=-1)


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(x * (1 - SLACK) - SLACK, 0)


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + SLACK


class Bounds:
    """Entries and bounds of the vectors of a block (n x parts, and lower n x parts x entries)."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.vectors, self.codes, self.upper, self.lower = vectors, codes, upper, lower
        self.measured = 0

    @classmethod
    def whole(cls, vectors: np.ndarray, books: np.ndarray) -> Bounds:
        """Of vectors (n x parts x width) that have no bounds yet: every distance is taken."""
        n, parts, _ = vectors.shape
        out = cls(vectors, np.empty((n, parts), np.int64), np.empty((n, parts)), np.empty((n, parts, books.shape[1])))
        for p in range(parts):
            d = squared(vectors[:, p, None, :], books[p][None])
            out.codes[:, p] = d.argmin(axis=1)  # the first of equals
            out.upper[:, p] = up(np.sqrt(d.min(axis=1)))
            out.lower[:, p] = down(np.sqrt(d))
        out.measured = n * parts * books.shape[1]
        return out

    def moved(self, steps: np.ndarray) -> None:
        """Shift bounds by how far each entry went (parts x entries, rounded up)."""
        for p in range(steps.shape[0]):
            self.upper[:, p] = up(self.upper[:, p] + steps[p][self.codes[:, p]])
            self.lower[:, p] = down(self.lower[:, p] - steps[p])

    def assign(self, books: np.ndarray) -> None:
        """Find the nearest entry of every part, measuring only what no bound rules out."""
        entries = books.shape[1]
        for p, book in enumerate(books):
            between = np.sqrt(squared(book[:, None], book[None]))
            half = down(between / 2)
            np.fill_diagonal(half, np.inf)
            code, x = self.codes[:, p], self.vectors[:, p]
            # another entry can be as near only if half its distance to ours is not above the upper bound
            open_rows = np.flatnonzero(half.min(axis=1)[code] <= self.upper[:, p]) if entries > 1 else np.zeros(0, np.int64)
            rows = open_rows[((half[code[open_rows]] <= self.upper[open_rows, p, None]) & (self.lower[open_rows, p] <= self.upper[open_rows, p, None])).any(axis=1)]
            best = squared(x[rows], book[code[rows]])
            self.upper[rows, p] = up(np.sqrt(best))
            self.lower[rows, p, code[rows]] = down(np.sqrt(best))
            asked = (half[code[rows]] <= self.upper[rows, p, None]) & (self.lower[rows, p] <= self.upper[rows, p, None])
            asked[np.arange(len(rows)), code[rows]] = False
            at, k = np.nonzero(asked)
            d = squared(x[rows[at]], book[k])
            self.lower[rows[at], p, k] = down(np.sqrt(d))
            self.measured += len(rows) + len(at)
            order = np.lexsort((k, d, at))  # the nearest of each row first, ties by index
            first = order[np.diff(at[order], prepend=-1) != 0]
            own, d, k = at[first], d[first], k[first]
            better = (d < best[own]) | ((d == best[own]) & (k < code[rows[own]]))
            own, d, k = own[better], d[better], k[better]
            self.codes[rows[own], p] = k
            self.upper[rows[own], p] = up(np.sqrt(d))

    def sums(self, entries: int) -> tuple[np.ndarray, np.ndarray]:
        n, parts, width = self.vectors.shape
        slot = (self.codes + np.arange(parts) * entries).ravel()
        total = np.zeros((parts * entries, width), np.int64)
        np.add.at(total, slot, self.vectors.reshape(-1, width))
        return total, np.bincount(slot, minlength=parts * entries)

    def stored(self) -> tuple[bytes, bytes, bytes, float]:
        """codes, upper (32 bits, rounded up), lower (8 bits of the largest, rounded down) and the largest lower bound."""
        top = float(self.lower.max(initial=0)) or 1.0
        upper = np.nextafter(self.upper.astype(np.float32), np.float32(np.inf))
        return self.codes.astype(np.uint8).tobytes(), upper.tobytes(), np.floor(self.lower * (255 / top) * (1 - SLACK)).astype(np.uint8).tobytes(), top

    @classmethod
    def read(cls, vectors: np.ndarray, codes: bytes, upper: bytes, lower: bytes, top: float, entries: int) -> Bounds:
        n, parts, _ = vectors.shape
        low = np.frombuffer(lower, np.uint8).reshape(n, parts, entries) * (top / 255)
        return cls(vectors, np.frombuffer(codes, np.uint8).reshape(n, parts).astype(np.int64), np.frombuffer(upper, np.float32).reshape(n, parts).astype(np.float64), down(low))


def added(df: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of all blocks: partial sums in each task, then by entry in Spark."""
    schema = pa.schema([("entry", pa.int32()), ("count", pa.int64()), ("total", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for batch in batches:
            for raw, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, n = np.frombuffer(raw, np.int64), np.frombuffer(n, np.int64)
                total, count = (raw, n) if total is None else (total + raw, count + n)
        if total is not None:
            lists = pa.ListArray.from_arrays(np.arange(len(count) + 1, dtype=np.int32) * width, total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(count), dtype=np.int32)), pa.array(count), lists], schema=schema)

    rows = df.select("sums", "counts").mapInArrow(run, "entry int, count long, total array<long>")
    one = rows.groupBy("entry").agg(F.sum("count").alias("count"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(width)]).orderBy("entry").collect()
    return np.array([[r[f"t{i}"] for i in range(width)] for r in one], np.int64), np.array([r["count"] for r in one], np.int64)


def next_books(books: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means; unused entries stay."""
    out = books.reshape(-1, books.shape[2]).copy()
    used = count > 0
    out[used] = total[used] // count[used, None]
    return out.reshape(books.shape)


def compressed(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable vector (see quantised).

    code: the entry of each part, two hexadecimal digits each (entries <= 256);
    error: squared distances summed over parts; label_error: error summed over
    rows of the same label, null ones together (null where it passes 64 bits).
    Codebooks begin with the smallest distinct vec_ids, fewer than entries where
    there are fewer; of several vectors of one vec_id the least begins. A row
    without a vec_id is coded, but begins no codebook. Repeated rows count each
    time. An empty table, or one without a usable vector, gives no rows; so does
    one in which no usable row has a vec_id. Other columns are left out.
    """
    return trained(df, parts, entries, rounds)[0]


def trained(df: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray, list[int]]:
    """compressed's rows, the codebooks (parts x entries x width), and how many distances each assignment took."""
    ship_code(df.sparkSession)
    vectors, length = quantised(df, parts)
    kinds = {f.name: f for f in df.schema.fields}
    named = StructType([kinds["vec_id"], kinds["label"]])
    result = StructType([*named.fields]).add("code", "string").add("error", "long")
    books = first_codebooks(vectors, length, parts, entries) if length else np.zeros((parts, 0, 1), np.int64)
    if not books.shape[1]:
        none = df.sparkSession.createDataFrame([], result).withColumn("label_error", F.lit(0).cast("long")).withColumn("codebooks_sha256", F.lit(""))
        return none.drop("label"), books, []
    width, entries = books.shape[2], books.shape[1]
    head = StructType().add("ids", ArrayType(kinds["vec_id"].dataType)).add("labels", ArrayType(kinds["label"].dataType))
    state_type = StructType([*head.fields, *StructType.fromDDL(STATE).fields])
    state_arrow = to_arrow_schema(state_type)

    def row(ids: pa.Array, labels: pa.Array, x: Bounds) -> pa.RecordBatch:
        total, count = x.sums(entries)
        values = (x.vectors.astype(np.int32).tobytes(), *x.stored(), total.tobytes(), count.astype(np.int64).tobytes(), x.measured)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, labels)]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([*lists, *(pa.array([v]) for v in values)], state_arrow, strict=True)], schema=state_arrow)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = part.column(2).flatten().to_numpy().reshape(part.num_rows, parts, width)
                yield row(part.column(0), part.column(1), Bounds.whole(x, books))
            release()

    def read(batch: pa.RecordBatch, i: int, steps: np.ndarray, now: np.ndarray) -> tuple[pa.Array, pa.Array, Bounds]:
        ids, labels = (batch.column(j).slice(i, 1).flatten() for j in range(2))
        raw, codes, upper, lower, top = (batch.column(2 + j)[i].as_py() for j in range(5))
        x = Bounds.read(np.frombuffer(raw, np.int32).reshape(len(ids), parts, width).astype(np.int64), codes, upper, lower, top, entries)
        x.moved(steps)
        x.assign(now)
        return ids, labels, x

    state = stored(vectors.select("vec_id", "label", "q").mapInArrow(begin, state_type), "elkan", "zstd")
    measured: list[int] = []
    for turn in range(rounds):
        new = next_books(books, *added(state, width))
        steps = up(np.sqrt(squared(new, books)))
        books = new

        def again(batches: Iterator[pa.RecordBatch], steps=steps, books=books) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield row(*read(batch, i, steps, books))
                release()

        if turn < rounds - 1:
            state, old = stored(state.mapInArrow(again, state_type), "elkan", "zstd"), state
            measured.append(old.agg(F.sum("measured")).first()[0])
            discard(old)
    coded = StructType([*result.fields]).add("measured", "long")
    final_arrow = to_arrow_schema(coded)

    def finish(batches: Iterator[pa.RecordBatch], steps=steps, books=books) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, x = read(batch, i, steps, books)
                error = sum(squared(x.vectors[:, p], books[p][x.codes[:, p]]) for p in range(parts))
                codes = x.codes.astype(np.uint8).tobytes().hex()
                code = [codes[j : j + 2 * parts] for j in range(0, len(codes), 2 * parts)]
                taken = np.zeros(len(ids), np.int64)
                taken[0] = x.measured
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([ids, labels, pa.array(code), pa.array(error), pa.array(taken)], final_arrow, strict=True)], schema=final_arrow)
            release()

    done = stored(state.mapInArrow(finish, coded), "elkan-codes")
    measured += [t.agg(F.sum("measured")).first()[0] for t in (state, done)]
    discard(state)
    groups = stored(done.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("rows")), "elkan-labels")
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = joined_by_weight(done.drop("measured"), groups, ["label"], "rows").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
    return out, books, measured
