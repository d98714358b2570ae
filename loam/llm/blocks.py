"""Corpus-wide counts over blocks of documents.

A block is some megabytes of text, chosen by a hash of each row. A worker turns
a block into sorted arrays of 64-bit keys, cuts them by key range into parts and
ships each part as one binary value; the task of a part sees that part of every
block, and answers each block in the order of its keys. So a shuffled row
stands for thousands of keys, a frequent key is one key of each block that has
it, and no task holds more than its part.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_code
from .common import as_bytes, hold, memory, release

#: Characters of text in a block, and keys (about) in a part.
BLOCK_CHARS, PART_KEYS = 4_000_000, 500_000
LEAST_BLOCKS = 32
MEMORY = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)

class WordHashes(dict):
    """64-bit hashes of words; short ones are remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) < 48:
            if len(self) > MEMORY:
                self.clear()
            self[word] = value
        return value


HASHES = memory("hashes", WordHashes)


def word_hashes(words: list[bytes]) -> np.ndarray:
    hold("hashes")
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def block_count(df: DataFrame, text: str = "text", chars: int = BLOCK_CHARS) -> int:
    """Blocks for a table, in proportion to its characters; reads the text column once."""
    total = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(LEAST_BLOCKS, math.ceil(total / chars))


def part_count(keys: float) -> int:
    """Parts for about so many keys, a power of two."""
    return 1 << max(4, math.ceil(math.log2(max(1.0, keys / PART_KEYS))))


def scattered(df: DataFrame, n: int, text: str = "text", more: tuple[Column, ...] = ()) -> DataFrame:
    """block and packet: the rows (doc_id, text, more) that one batch of a task holds for a block, compressed.

    A row's block is a hash of its identifier and text, so that it does not
    hang on how the input is split; rows of a batch that are equal in both go
    to blocks one after the other, so that many of them do not fill one.
    """
    ship_code(df.sparkSession)
    source = df.select("doc_id", F.col(text).alias("text"), *more, F.xxhash64("doc_id", F.col(text)).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            first = batch.column(batch.num_columns - 1).to_numpy()
            blocks = (first + repetition(first)) % n
            order = np.argsort(blocks, kind="stable")
            edges = np.flatnonzero(np.diff(blocks[order], prepend=-1)).tolist()
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
            numbers, packets = [], []
            for begin, end in zip(edges, [*edges[1:], len(order)], strict=True):
                at = order[begin:end].tolist()
                numbers.append(int(blocks[at[0]]))
                packets.append(squeeze.compress(pickle.dumps([[c[i] for i in at] for c in columns], 5)))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(packets, pa.binary())], schema=PACKETS)

    return source.mapInArrow(run, "block int, packet binary")


def repetition(keys: np.ndarray) -> np.ndarray:
    """How many earlier places hold the same key, for each place."""
    order = np.argsort(keys, kind="stable")
    runs = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(runs, np.diff(runs, append=len(keys)))
    return out


PACKETS = pa.schema([("block", pa.int32()), ("packet", pa.binary())])


def unpacked(table: pa.Table, columns: int = 2) -> list[list]:
    """The columns of a block's rows from its packets."""
    release()
    out: list[list] = [[] for _ in range(columns)]
    expand = zstandard.ZstdDecompressor()
    for packet in table.column("packet").to_pylist():
        for mine, new in zip(out, pickle.loads(expand.decompress(packet)), strict=True):
            mine += new
    return out


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are nearly all zero."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def expanded(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection that spreads keys over the whole range."""
    keys = keys ^ keys >> np.uint64(31)
    keys = keys * MIX
    return keys ^ keys >> np.uint64(29)


def grams(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of the k values from each place on, len(h) - k + 1 of them, in log k steps."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out: np.ndarray | None = None
    done, power, width = 0, h, 1
    factor = base  # base ** width
    rest = k
    while rest:
        if rest & 1:
            piece = power[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(factor) + piece
            done += width
        rest >>= 1
        if rest:
            power = power[:-width] * np.uint64(factor) + power[width:]
            factor = factor * factor & (1 << 64) - 1
            width *= 2
    return out


def sliding(a: np.ndarray, k: int, fn) -> np.ndarray:
    """fn (minimum or maximum) over each k consecutive values."""
    width = 1
    out = a
    while width * 2 <= k:
        out = fn(out[:-width], out[width:])
        width *= 2
    rest = k - width
    return fn(out[: len(out) - rest], out[rest:]) if rest else out


def cut(keys: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of the parts that sorted keys reach."""
    if not len(keys):
        return
    own = (keys >> np.uint64(64 - (parts.bit_length() - 1))).astype(np.int64) if parts > 1 else np.zeros(len(keys), np.int64)
    begins = np.flatnonzero(np.diff(own, prepend=-1))
    yield from zip(own[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True)


def words_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of a block, one text after the other, and each text's number of words."""
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text:
            own = as_bytes(text).split()  # splits at space and \t \n \v \f \r only
            counts[i] = len(own)
            words += own
    return words, counts
