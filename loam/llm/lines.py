"""Operator 11: repeated lines by a sharded minimal perfect hash.

A worker hashes the lines of a packet of documents. The distinct hashes, each
with its number of documents and its largest doc_id, are dealt to shards by
range; a shard's task builds a minimal perfect hash over its own and lays a
fingerprint, a count and a doc_id at each hash's number, without the hashes
themselves. A packet then sends its distinct hashes, cut by shard, past those
arrays, and gets back what to drop; lines never meet lines. Only numbers travel:
texts stay with their rows until the numbers of their dropped lines are known.

A line that a third of all documents hold is one hash in each packet, three
rows of it at most in the count, and one answer to each packet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .blocks import MIX, cut, mixed
from .common import as_bytes, release, slices, stored
from .rlz import column

#: Distinct lines in a shard, about; characters of the documents of a packet.
SHARD_KEYS, PACKET_CHARS = 400_000, 2_000_000
LEAST_SHARDS = 16
#: The place of a null doc_id in the order: below all others.
NO_ID = -(1 << 63)
#: ASCII white space that a line's key loses at both ends.
WHITE = " \t\n\x0b\f\r"

PACKET = "packet long, n long, keys binary, tops binary, rows binary, ids binary, entries binary"
INDEX = "shard int, sizes array<long>, bits binary, prints binary, counts binary, last binary"


class PerfectHash:
    """Minimal perfect hash of 128-bit keys in levels of bits.

    At each level a key has a place; a key alone at its place sets the bit
    there, the others go to the next level. A key's number is the number of
    bits before its own.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(high ^ mixed(low + np.uint64((level + 1) * int(MIX) % (1 << 64)))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """Of distinct keys, in any order."""
        sizes, levels = [], []
        while len(high):
            if len(sizes) == 200:
                raise ValueError("keys are not distinct")
            size = -(-2 * len(high) // 64) * 64
            at = cls.places(high, low, len(sizes), size)
            times = np.bincount(at, minlength=size)
            levels.append(np.packbits(times == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = times[at] > 1
            high, low = high[left], low[left]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's number, below the number of keys; -1 or any number for a key that is not in."""
        out = np.full(len(high), -1, np.int64)
        left, start = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            at = start + self.places(high[left], low[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = word >> bit & np.uint64(1) == 1
            below = np.bitwise_count(word & (np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left, start = left[~hit], start + size
        return out


def line_key(line: str) -> str:
    return line.strip(WHITE)


def packets(df: DataFrame, least: int, shortest: int) -> DataFrame:
    """The long lines of runs of documents as hashes (PACKET); no shuffle.

    keys: the distinct hashes, sorted; tops: (key's place, doc_id) of each key's
    least largest doc_ids; rows and ids: hash and doc_id of the documents that
    hold one; entries: (document's place, line's number, key's place).
    """
    ship_code(df.sparkSession)
    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row"), F.spark_partition_id().alias("task"))

    def one(number: int, ids: list, texts: list[str], rows: np.ndarray) -> tuple:
        found, hashes = [], []
        for i, text in enumerate(texts):
            for j, line in enumerate(text.split("\n")):
                if len(key := line_key(line)) >= shortest:
                    hashes.append(xxhash.xxh3_128_digest(as_bytes(key).lower()))
                    found.append((i, j))
        pairs = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2)
        keys, slot = distinct(pairs)
        entries = np.array(found, np.int32).reshape(-1, 2)
        held = np.array([NO_ID if i is None else i for i in ids], np.int64)
        top = np.unique(np.stack([slot, held[entries[:, 0]]], axis=1), axis=0)[::-1]  # by key, largest doc_id first
        place = np.arange(len(top)) - np.searchsorted(-top[:, 0], -top[:, 0])
        entries = np.column_stack([entries, slot.astype(np.int32)])
        return number, len(keys), keys.tobytes(), top[place < least].tobytes(), rows.tobytes(), held.tobytes(), entries.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            ids, rows, task = batch.column(0).to_pylist(), batch.column(2).to_numpy(), batch.column(3)
            made = []
            for part in slices(texts, PACKET_CHARS):
                made.append(one((task[0].as_py() << 32) + count, ids[part], texts[part], rows[part]))
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), ARROW_PACKET, strict=True)], schema=ARROW_PACKET) if made else empty(ARROW_PACKET)
            release()

    return source.mapInArrow(run, PACKET)


ARROW_PACKET = pa.schema([("packet", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("keys", "tops", "rows", "ids", "entries"))])
ARROW_INDEX = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("bits", "prints", "counts", "last"))])


def empty(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], type=f.type) for f in schema], schema=schema)


def distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows of an n x 2 array, and each row's place among them."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    sorted_pairs = pairs[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_pairs[1:] != sorted_pairs[:-1]).any(axis=1)
    slot = np.empty(len(order), np.int64)
    slot[order] = np.cumsum(new) - 1
    return sorted_pairs[new], slot


def shard_count(packed: DataFrame) -> int:
    """Shards for the lines of packets, a power of two."""
    total = packed.agg(F.sum("n")).first()[0] or 0
    return 1 << math.ceil(math.log2(max(LEAST_SHARDS, total / SHARD_KEYS)))


def line_index(packed: DataFrame, shards: int, least: int) -> DataFrame:
    """One row per shard (INDEX): the perfect hash of its distinct lines, and arrays in the order of their numbers.

    prints: 32 bits of each hash; counts: documents, as one byte that stops at
    least; last: the largest doc_id.
    """
    bits = shards.bit_length() - 1

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                top = np.frombuffer(held, np.int64).reshape(-1, 2)
                pairs = np.frombuffer(keys, np.int64).reshape(-1, 2)[top[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(top[:, 1])], names=["high", "low", "doc"])

    held = packed.select("keys", "tops").mapInArrow(tops, "high long, low long, doc long").distinct()
    counted = held.groupBy("high", "low").agg(F.least(F.count("*"), F.lit(least)).alias("documents"), F.max("doc").alias("last"))
    counted = counted.withColumn("shard", F.shiftrightunsigned("high", 64 - bits).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        high, low, documents, last = (t.column(c).to_numpy() for c in ("high", "low", "documents", "last"))
        high, low = high.view(np.uint64), low.view(np.uint64)
        made = PerfectHash.build(high, low)
        at = np.argsort(made.numbers(high, low))
        row = (t.column("shard")[0].as_py(), made.sizes, made.words.tobytes(), low[at].astype(np.uint32).tobytes(), documents[at].astype(np.uint8).tobytes(), last[at].astype(np.int64).tobytes())
        return pa.Table.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, ARROW_INDEX, strict=True)], schema=ARROW_INDEX)

    return counted.groupBy("shard").applyInArrow(build, INDEX)


def probed(packed: DataFrame, index: DataFrame, shards: int, least: int) -> DataFrame:
    """packet, hits: of a packet's keys in one shard, (place, largest doc_id) of those in least documents or more.

    A task holds the arrays of one shard and reads its packets one after the other.
    """
    index_columns = [f.name for f in ARROW_INDEX][1:]

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packet, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = np.frombuffer(raw, np.uint64).reshape(-1, 2)
                pieces = [(p, packet, b, keys[b:e].tobytes()) for p, b, e in cut(keys[:, 0], shards)]
                if pieces:
                    columns = zip(*pieces, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "packet", "start", "keys"])

    asked = packed.select("packet", "keys").mapInArrow(cuts, "shard int, packet long, start long, keys binary")
    both = index.unionByName(asked, allowMissingColumns=True).select("shard", "packet", "start", "keys", *index_columns)
    # the arrays of a shard come before the packets: a null packet is the least
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "packet")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = prints = counts = last = None
        for batch in batches:
            packet_ids, starts, out = batch.column(1).to_pylist(), batch.column(2), []
            for i, packet in enumerate(packet_ids):
                if packet is None:
                    sizes, *arrays = (batch.column(4 + j)[i].as_py() for j in range(5))
                    words, prints, counts, last = map(np.frombuffer, arrays, (np.uint64, np.uint32, np.uint8, np.int64))
                    shard = PerfectHash(sizes, words)
                    continue
                keys = np.frombuffer(batch.column(3)[i].as_py(), np.uint64).reshape(-1, 2)
                number = shard.numbers(keys[:, 0], keys[:, 1])
                hit = np.flatnonzero((number >= 0) & (prints[number] == keys[:, 1].astype(np.uint32)) & (counts[number] >= least))
                if len(hit):
                    out.append((packet, np.column_stack([starts[i].as_py() + hit, last[number[hit]]]).astype(np.int64).tobytes()))
            release()
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["packet", "hits"])

    return dealt.mapInArrow(probe, "packet long, hits binary")


def dropped_lines(df: DataFrame, least: int = 3, shortest: int = 20) -> DataFrame:
    """row, doc_id, lines: the numbers of the lines that each document loses; only documents that lose some.

    row is xxhash64(doc_id, text). Rows that are equal in both are one row here.
    """
    packed = stored(packets(df, least, shortest), "line-packets", "zstd")
    shards = shard_count(packed)
    index = stored(line_index(packed, shards, least), "line-index")
    answers = probed(packed, index, shards, least)
    result = "row long, doc_id long, lines array<int>"
    arrow = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lines", pa.list_(pa.int32()))])

    def decide(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return arrow.empty_table()
        rows, ids = (np.frombuffer(t.column(c)[0].as_py(), np.int64) for c in ("rows", "ids"))
        entries = np.frombuffer(t.column("entries")[0].as_py(), np.int32).reshape(-1, 3)
        last = np.zeros(t.column("n")[0].as_py(), np.int64)
        hit = np.zeros(len(last), bool)
        pairs = column(answers, "hits", np.int64).reshape(-1, 2)
        hit[pairs[:, 0]], last[pairs[:, 0]] = True, pairs[:, 1]
        gone = entries[hit[entries[:, 2]] & (ids[entries[:, 0]] != last[entries[:, 2]])]
        own, first = np.unique(gone[:, 0], return_index=True)
        lines = pa.ListArray.from_arrays(np.append(first, len(gone)).astype(np.int32), np.ascontiguousarray(gone[:, 1]))
        held = ids[own]
        return pa.Table.from_arrays([pa.array(rows[own]), pa.array(held, mask=held == NO_ID), lines], schema=arrow)

    found = packed.select("packet", "n", "rows", "ids", "entries").groupBy("packet").cogroup(answers.groupBy("packet")).applyInArrow(decide, result)
    return found.groupBy("row", "doc_id").agg(F.first("lines").alias("lines"))


def kept_lines(df: DataFrame, least: int = 3, shortest: int = 20) -> DataFrame:
    """What each text keeps when lines found in least documents stay in the largest doc_id alone.

    Columns: doc_id, n_lines long, n_dropped long, kept_sha256. A line's key is
    the line without ASCII white space at its ends, A-Z in lower case; keys
    under shortest code points stay everywhere, and so does every line in the
    largest doc_id that holds its key. Rows with one doc_id are one document;
    rows without one are one document too, below all others. A null or empty
    text is one empty line. doc_id is an integer; other columns are left out.
    """
    # a document's numbers come to its text; where a row is repeated very often, adaptive execution splits its side
    texts = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("row"))
    gone = dropped_lines(df, least, shortest).select(F.col("row").alias("_row"), F.col("doc_id").alias("_id"), "lines").hint("shuffle_hash")
    met = texts.join(gone, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select("doc_id", "text", "lines")
    kept = texts.select("doc_id").schema.add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, lines in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = text.split("\n")
                n = len(parts)
                if lines:
                    out = set(lines)
                    text = "\n".join(x for i, x in enumerate(parts) if i not in out)
                made.append((n, len(lines or ()), hashlib.sha256(as_bytes(text)).hexdigest()))
            columns = [pa.array([x[i] for x in made], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=kept.names)

    return met.mapInArrow(run, kept)
