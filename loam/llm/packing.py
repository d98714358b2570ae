"""Operator 5: order-preserving packing of token streams by dynamic programming."""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship_code
from .bpe import tree_encoder, vocabulary
from .common import release, slices

#: Cost of a window cut, in tokens of padding: inside a document after a sentence, and inside a sentence.
SENTENCE_CUT, HARD_CUT = 2, 24
#: A sentence longer than a window may be cut each time so many of its tokens have passed.
STRETCH = 64
#: Tokens held before settled windows are looked for.
RUN_TOKENS = 1 << 17

PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Cuts:
    """Cheapest window ends over a stream that grows.

    A window may end at the places given, each at most size after the one
    before, for the cost given; a window of n tokens pays size - n for padding,
    or nothing where n is one of free. best[j] is the least cost of windows
    that end at at[j]: size - at[j] + min(best[i] + at[i]) over the places within
    size, whose minimum a queue with rising values keeps at its head. Each place
    enters and leaves the queue once.
    """

    def __init__(self, size: int, free: tuple[int, ...] = (), start: int = 0):
        self.size, self.free = size, free
        self.at, self.best, self.back = [start], [0.0], [0]
        self.queue: deque[tuple[float, int, int]] = deque([(float(start), start, 0)])
        self.number = {start: 0} if free else {}
        self.first = 0  # number of the place at[0]

    def extend(self, places: list[int], costs: list[float]) -> None:
        at, best, back, queue, number, first, size = self.at, self.best, self.back, self.queue, self.number, self.first, self.size
        for j, (here, cost) in enumerate(zip(places, costs, strict=True), first + len(at)):
            while queue[0][1] < here - size:
                queue.popleft()
            value, _, i = queue[0]
            value += size - here
            for length in self.free:
                k = number.get(here - length)
                if k is not None and best[k - first] < value:
                    value, i = best[k - first], k
            value += cost
            at.append(here)
            best.append(value)
            back.append(i)
            if self.free:
                number[here] = j
            value += here
            while queue and queue[-1][0] >= value:
                queue.pop()
            queue.append((value, here, j))

    def path(self, j: int) -> list[int]:
        """Window ends, ascending, up to place number j."""
        cuts = []
        while j > self.first:
            cuts.append(self.at[j - self.first])
            j = self.back[j - self.first]
        return cuts[::-1]

    def settled(self) -> list[int]:
        """The window ends that every continuation of the stream shares, which are then forgotten.

        A later window can begin only at a place within size of the last one.
        The paths of all these places are followed back until they meet.
        """
        j = self.first + len(self.at) - 1
        low = bisect_right(self.at, self.at[-1] - self.size) + self.first
        open_places = {*range(low, j + 1)}
        while len(open_places) > 1:
            if j in open_places:
                open_places.remove(j)
                open_places.add(self.back[j - self.first])
            j -= 1
        (meet,) = open_places
        cuts = self.path(meet)
        gone = meet - self.first
        if gone:
            for place in self.at[:gone]:
                self.number.pop(place, None)
            self.at, self.best, self.back, self.first = self.at[gone:], self.best[gone:], self.back[gone:], meet
        return cuts

    def rest(self) -> list[int]:
        """The remaining window ends if the stream ends at the last place."""
        return self.path(self.first + len(self.at) - 1)


def choose_cuts(at: list[int], cost: list[float], size: int, free: tuple[int, ...] = ()) -> list[int]:
    """Window ends, ascending, over a whole stream from at[0] to at[-1]; see Cuts."""
    cuts = Cuts(size, free, at[0])
    cuts.extend(at[1:], cost[1:])
    return cuts.rest()


class Packer:
    """One partition's stream of documents, cut into windows as it grows."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.sequence = size, first_sequence
        self.docs: list[tuple] = []  # (doc_id, ids with the end mark, where it begins in the stream)
        self.cuts = Cuts(size, (size // 2, size // 4))
        self.begin = self.end = 0

    def add(self, doc_id, ids: np.ndarray, sentence_ends: np.ndarray) -> None:
        last = self.end
        self.end = last + len(ids)
        places = (sentence_ends + last).tolist()
        costs = [SENTENCE_CUT] * len(places)
        if places and places[-1] == self.end:
            places.pop()
            costs.pop()
        places.append(self.end)
        costs.append(0)
        if max(map(int.__sub__, places, [last, *places])) > self.size:
            places, costs = self.stretched(places, costs, last)
        self.cuts.extend(places, costs)
        self.docs.append((doc_id, ids, last))

    def stretched(self, places: list[int], costs: list[float], last: int) -> tuple[list[int], list[float]]:
        """The places with further ones inside sentences longer than a window."""
        out, prices = [], []
        step = min(STRETCH, self.size)
        for place, cost in zip(places, costs, strict=True):
            inside = [*range(last + step, place, step)] if place - last > self.size else []
            out += [*inside, place]
            prices += [HARD_CUT] * len(inside) + [cost]
            last = place
        return out, prices

    def windows(self, final: bool) -> list[int]:
        if not final:
            return self.cuts.settled()
        cuts = self.cuts.rest()
        # the last window is split into powers of two where that is cheaper than padding it
        begin = cuts[-2] if len(cuts) > 1 else self.begin
        rest = self.end - begin
        if self.size - rest > HARD_CUT * (rest.bit_count() - 1) and rest:
            cuts.pop()
            for bit in range(rest.bit_length() - 1, -1, -1):
                if rest >> bit & 1:
                    begin += 1 << bit
                    cuts.append(begin)
        return cuts

    def cut(self, final: bool) -> Iterator[tuple]:
        """Rows of the windows that are settled; what lies behind them stays."""
        if self.end == self.begin:
            return
        begin, d = self.begin, 0
        for stop in self.windows(final):
            place = begin
            while place < stop:
                doc_id, ids, base = self.docs[d]
                upto = min(stop, base + len(ids))
                yield doc_id, place - base, upto - place, zlib.crc32(ids[place - base : upto - base]), len(ids), self.sequence, place - begin
                place = upto
                if upto == base + len(ids):
                    d += 1
            self.sequence += 1
            begin = stop
        self.docs = self.docs[d:]
        self.begin = begin


def pack(
    df: DataFrame, path: str, size: int = 2048, end_id: int = 1, keep: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pack every text, in the order of its partition, into sequences of size tokens.

    A text becomes its identifiers and then end_id. Windows may end behind a
    document at no cost and behind a sentence for SENTENCE_CUT; inside one only
    where it is longer than a window, each STRETCH tokens, for HARD_CUT. Padding
    costs 1 a token; windows of half and a quarter of size need none. The sum is
    least over the partition: windows are given out once no continuation of the
    stream can change them. A partition's last window may be split into powers
    of two. One row per piece: keep, start, length, ids_crc32, doc_tokens,
    sequence_id (partition number << 33 | count), offset.

    A null or empty text is the end mark alone. Repeated rows are packed each;
    an empty table gives no rows; a text longer than any window spans several.
    No shuffle: a task holds the documents whose windows are not settled, which
    is some windows' worth, and a lost task is redone from its input. Other
    columns of df are left out.
    """
    ship_code(df.sparkSession)
    source = df.select(keep, df[text].alias("__text"))
    schema = StructType([source.schema[keep], *StructType.fromDDL(PIECE).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(path)
        ends = sentence_enders(path)
        packer = Packer(size, TaskContext.get().partitionId() << 33)
        mark = np.array([end_id], "<u4")
        look = RUN_TOKENS

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts):
                rows: list[tuple] = []
                for key, raw in zip(keys[part], encoder.encode(texts[part]), strict=True):
                    ids = np.frombuffer(raw, "<u4")
                    packer.add(key, np.concatenate([ids, mark]), np.flatnonzero(ends[ids[:-1]]) + 1)
                    if packer.end > look:
                        rows += packer.cut(False)
                        look = packer.end + RUN_TOKENS
                yield batch_of(rows)
            release()
        yield batch_of(list(packer.cut(True)))

    return source.mapInArrow(run, schema)


def sentence_enders(path: str) -> np.ndarray:
    """For each identifier, whether its token is punctuation that ends a sentence."""
    v = vocabulary(path)
    bare = [t.removesuffix(v.suffix) if t.endswith(v.suffix) else "" for t in v.tokens]
    return np.array([bool(t) and t[-1] in ".!?" and not any(c.isalnum() for c in t) for t in bare])
