"""Operator 9: repeated passages by relative Lempel-Ziv parsing against every block.

Every block of documents is part of the reference. The reference index holds
each window of WINDOW words that stands at two places or more, once: at its
first place, by block and then by place in the block. So the longest match from
a word on is the only one, and the greedy parse is followed window by window:
a factor goes on while the next window's indexed place is the next one of the
same block. Where it stops, the windows across the factor's boundary are looked
up as well, so the next factor may begin in words that the last one covers. A
factor has WINDOW words at least, and the words of all factors are the repeated
passages. The text at an indexed place refers to itself.

Only windows that can recur are sent to the index: those whose anchor (the
least hash among the GRAM-word phrases in the window) is the anchor of another
place, here or in any other block. Equal windows have equal anchors, so none is
lost.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .blocks import BLOCK_CHARS, block_count, cut, expanded, grams, mixed, part_count, scattered, sliding, squeezed, unpacked, word_hashes, words_of
from .common import quoted, release, stored

WINDOW, GRAM = 35, 12
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Share of places that are anchors, for the number of parts: two in each run of WINDOW - GRAM + 2.
ANCHORS = 2 / (WINDOW - GRAM + 2)

SENT = "block int, part int, keys binary, checks binary, places binary, many binary"
ANSWER = "block int, kind int, part int, answer binary"
#: What the index says of a window: block and place of the entry, -1 for a window that stands once.
ENTRY = np.dtype([("block", "<i4"), ("place", "<i4")])


class Block:
    """Windows and anchors of one block's texts."""

    def __init__(self, texts: list, window: int):
        self.words, self.counts = words_of(texts)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.window = window
        gram = min(GRAM, window)
        self.hashes = word_hashes(self.words)
        places = len(self.words) - window + 1
        self.places = max(0, places)
        if places <= 0:
            self.valid = np.zeros(0, bool)
            self.anchor = np.zeros(0, np.uint64)
            self.anchors, self.many = np.zeros(0, np.uint64), np.zeros(0, bool)
            return
        last = np.repeat(self.starts[1:], self.counts)[:places]
        self.valid = np.arange(places) + window <= last
        g = mixed(grams(self.hashes, gram, BASES[0]))
        span = window - gram + 1
        low = sliding(g, span, np.minimum)
        self.anchor = mixed(low)
        held = np.where(self.valid, low, 0)
        edge = np.zeros(span - 1, np.uint64)
        chosen = g[sliding(np.concatenate([edge, held, edge]), span, np.maximum) == g]
        self.anchors, times = np.unique(mixed(chosen), return_counts=True)
        self.many = times > 1

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Places of valid windows whose anchor is shared."""
        if not self.places or not shared.any():
            return np.zeros(0, np.int64)
        keys = self.anchors[shared]
        at = np.minimum(np.searchsorted(keys, self.anchor), len(keys) - 1)
        return np.flatnonzero(self.valid & (keys[at] == self.anchor))

    def fingerprints(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """128-bit keys, sorted and distinct, of the windows at places (ascending).

        Returns both halves, the first place of each, which are many, and each
        place's key.
        """
        if not len(places):
            none = np.zeros(0, np.uint64)
            return none, none, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        a = mixed(grams(self.hashes, self.window, BASES[0])[places])
        b = mixed(grams(mixed(self.hashes), self.window, BASES[1])[places])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        slot = np.cumsum(new) - 1
        own = np.empty(len(places), np.int64)
        own[order] = slot
        return a[new], b[new], places[order][new], np.bincount(slot) > 1, own


def ordered(answers: dict[str, list], kind: int) -> list[bytes]:
    """A block's answers of a kind, by part."""
    return [x for _, x in sorted((p, x) for k, p, x in zip(answers["kind"], answers["part"], answers["answer"], strict=True) if k == kind)]


def flags_of(block: Block, answers: dict[str, list], parts: int) -> np.ndarray:
    pieces = ordered(answers, 1)
    sizes = [e - b for _, b, e in cut(block.anchors, parts)]
    if not sizes:
        return np.zeros(0, bool)
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(pieces, sizes, strict=True)]).astype(bool)


ARROW = {
    SENT: pa.schema([("block", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("checks", pa.binary()), ("places", pa.binary()), ("many", pa.binary())]),
    ANSWER: pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("answer", pa.binary())]),
}


def table_of(rows: list[tuple], kind: str) -> pa.Table:
    schema = ARROW[kind]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def send(block: int, keys: np.ndarray, many: np.ndarray, parts: int, checks: np.ndarray | None = None, places: np.ndarray | None = None) -> pa.Table:
    raw = lambda x, b, e, kind: b"" if x is None else x[b:e].astype(kind).tobytes()
    rows = [(block, p, squeezed(keys[b:e]), raw(checks, b, e, np.uint64), raw(places, b, e, np.int32), np.packbits(many[b:e]).tobytes()) for p, b, e in cut(keys, parts)]
    return table_of(rows, SENT)


def column(table: pa.Table, name: str, kind) -> np.ndarray:
    """The binary values of a column, one behind the other, without a Python object for each."""
    values = table.column(name).combine_chunks()
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    if not len(values):
        return np.zeros(0, kind)
    edges = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(memoryview(values.buffers()[2])[int(edges[0]) : int(edges[-1])], kind)


def gather(table: pa.Table) -> tuple[list, list[int], np.ndarray, np.ndarray]:
    release()
    keys = [expanded(x.as_buffer()) for x in table.column("keys")]
    sizes = [len(x) for x in keys]
    many = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=n) for x, n in zip(table.column("many"), sizes, strict=True)]).astype(bool)
    return table.column("block").to_pylist(), sizes, np.concatenate(keys), many


def answer_anchors(table: pa.Table) -> pa.Table:
    """For each key of each block, whether the anchor stands at two places or more."""
    blocks, sizes, keys, many = gather(table)
    part = table.column("part")[0].as_py()
    _, slot, times = np.unique(keys, return_inverse=True, return_counts=True)
    shared = (times > 1) | (np.bincount(slot, many) > 0)
    flags = np.split(shared[slot], np.cumsum(sizes)[:-1])
    return table_of([(b, 1, part, np.packbits(f).tobytes()) for b, f in zip(blocks, flags, strict=True)], ANSWER)


def answer_windows(table: pa.Table) -> pa.Table:
    """For each key of each block, the window's index entry, or -1 if it stands once."""
    blocks, sizes, a, many = gather(table)
    part = table.column("part")[0].as_py()
    b = column(table, "checks", np.uint64)
    owner = np.repeat(np.array(blocks, np.int32), sizes)
    order = np.lexsort((owner, b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    del a, b
    slot = np.cumsum(new, dtype=np.int32) - 1
    first = order[new]
    repeated = (np.bincount(slot) > 1) | (np.bincount(slot, many[order]) > 0)
    entries = np.empty(len(first), ENTRY)
    entries["block"] = np.where(repeated, owner[first], -1)
    entries["place"] = np.where(repeated, column(table, "places", np.int32)[first], -1)
    out = np.empty(len(order), ENTRY)
    out[order] = entries[slot]
    return table_of([(k, 2, part, x.tobytes()) for k, x in zip(blocks, np.split(out, np.cumsum(sizes)[:-1]), strict=True)], ANSWER)


def parsed(df: DataFrame, window: int, outputs: str, describe) -> DataFrame:
    """Parse every row of df and give doc_id and what describe(block, i, text, factors) returns."""
    n = block_count(df)
    docs = scattered(df, n)
    words = n * BLOCK_CHARS / 6
    parts1, parts2 = part_count(words * ANCHORS), part_count(words / 2)
    first = docs.groupBy("block").applyInArrow(
        lambda t: send(t.column("block")[0].as_py(), (x := Block(unpacked(t)[1], window)).anchors, x.many, parts1), SENT
    )
    anchors = stored(first.groupBy("part").applyInArrow(answer_anchors, ANSWER), "anchors")

    def windows(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table_of([], SENT)
        x = Block(unpacked(t)[1], window)
        a, b, places, many, _ = x.fingerprints(x.candidates(flags_of(x, answers.to_pydict(), parts1)))
        return send(t.column("block")[0].as_py(), a, many, parts2, b, places)

    second = docs.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow(windows, SENT)
    answers = anchors.unionByName(second.groupBy("part").applyInArrow(answer_windows, ANSWER))
    schema = StructType([df.schema["doc_id"], *StructType.fromDDL(outputs).fields])
    arrow = to_arrow_schema(schema)

    def parse(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_arrays([pa.array([], type=f.type) for f in arrow], schema=arrow)
        ids, texts = unpacked(t)
        x = Block(texts, window)
        got = answers.to_pydict()
        places = x.candidates(flags_of(x, got, parts1))
        entries = np.full(x.places, -1, ENTRY)
        if len(places):
            entries[places] = np.frombuffer(b"".join(ordered(got, 2)), ENTRY)[x.fingerprints(places)[4]]
        found = factors(x, entries)
        edges = np.searchsorted(found["text"], np.arange(len(texts) + 1)).tolist()
        columns = list(zip(*(describe(x, i, texts[i], found[edges[i] : edges[i + 1]]) for i in range(len(texts))), strict=True))
        return pa.Table.from_arrays([pa.array(ids, type=arrow.field(0).type), *(pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(parse, schema)


#: A factor: number of its text in the block, its first word there, words, and where the reference has it.
FACTOR = np.dtype([("text", "<i8"), ("first", "<i8"), ("words", "<i8"), ("block", "<i4"), ("place", "<i4")])


def factors(x: Block, entries: np.ndarray) -> np.ndarray:
    """The greedy parse of all texts of a block, left to right.

    entries holds the index entry of the window at each place. A factor begins
    at an indexed window and goes on while the next window, in the same text,
    has the next place of the same reference block as its entry.
    """
    held = entries["block"] >= 0
    goes_on = np.zeros(len(entries), bool)
    goes_on[1:] = held[1:] & (entries["block"][1:] == entries["block"][:-1]) & (entries["place"][1:] == entries["place"][:-1] + 1)
    owner = np.repeat(np.arange(len(x.counts)), x.counts)[: len(entries)]
    goes_on[1:] &= owner[1:] == owner[:-1]
    begins = np.flatnonzero(held & ~goes_on)
    stops = np.flatnonzero(held & ~np.append(goes_on[1:], False)) if len(entries) else begins
    out = np.empty(len(begins), FACTOR)
    out["text"] = owner[begins]
    out["first"] = begins - x.starts[out["text"]]
    out["words"] = stops - begins + x.window
    out["block"], out["place"] = entries["block"][begins], entries["place"][begins]
    return out


def covered(n: int, found: np.ndarray) -> np.ndarray | None:
    """Which of a text's n words lie in a factor; None: none."""
    if not len(found):
        return None
    change = np.bincount(found["first"], minlength=n + 1) - np.bincount(found["first"] + found["words"], minlength=n + 1)
    return np.cumsum(change[:-1]) > 0


def duplicate_factors(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of df: doc_id and factors, an array of (first_word, n_words, reference_block, reference_place).

    A null or empty text, or one shorter than window words, has none. Blocks
    are numbered by hash of the rows, places count the block's words.
    """
    names = ("first_word", "n_words", "reference_block", "reference_place")

    def describe(x: Block, i: int, text, found: np.ndarray) -> tuple:
        return ([dict(zip(names, f[1:], strict=True)) for f in found.tolist()],)

    return parsed(df, window, "factors array<struct<first_word:int,n_words:int,reference_block:int,reference_place:int>>", describe)


def kept_words(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words left once every word of a factor is taken away.

    Columns: doc_id, n_words long, n_removed long, kept_sha256. Factors cover
    the windows whose words also start anywhere else, in the same or another
    row; repeated rows repeat each other. A null or empty text has no words; a
    null doc_id stays null; other columns of df are left out.
    """

    def describe(x: Block, i: int, text, found: np.ndarray) -> tuple:
        words = x.words[x.starts[i] : x.starts[i + 1]]
        gone = covered(len(words), found)
        left = words if gone is None else list(compress(words, ~gone))
        return len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()

    return parsed(df, window, "n_words long, n_removed long, kept_sha256 string", describe)


def replaced(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """df with each text that has repeated passages replaced by its kept words, joined by a space.

    Other texts stay as they are, null ones null. Rows are neither merged nor
    dropped: all columns travel with the text. n_chars, where df has it, follows the text.
    """

    def describe(x: Block, i: int, text, found: np.ndarray) -> tuple:
        gone = covered(int(x.counts[i]), found)
        changed = gone is not None
        return changed, b" ".join(compress(x.words[x.starts[i] : x.starts[i + 1]], ~gone)).decode("utf-8", "replace") if changed else text

    rest = [c for c in df.columns if c != "text"]
    packed = df.select(F.struct(*[F.col(quoted(c)) for c in rest]).alias("doc_id"), "text")
    done = parsed(packed, window, "changed boolean, text string", describe)
    new = {c: F.col("doc_id").getField(c) for c in rest} | {"text": F.col("text")}
    if "n_chars" in rest:
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast(df.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return done.select(*[new[c].alias(c) for c in df.columns])
