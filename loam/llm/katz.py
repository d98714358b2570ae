"""Operator 8: a bigram language model with Katz backoff, learned and applied block by block.

Counts of words and word pairs come from the training rows of all blocks (see
blocks). The task of a part of the keys adds them up and stores, in the shared
folder, each block's share of the count table. Good-Turing discounts follow
from the numbers of n-grams seen once, twice and so on. The backoff weight of
a history needs two sums over the pairs seen behind it; each pair is summed by
the one block that owns it, and histories of several blocks are added up in
parts again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .blocks import block_count, cut, expanded, mixed, part_count, scattered, squeezed, unpacked, word_hashes
from .common import as_bytes, id_bucket, stored

#: Characters in a block: larger blocks repeat fewer pairs.
CHARS = 10_000_000
#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Keys of the marks behind and before a text.
END, BEGIN = np.uint64(0xE4D), np.uint64(0xBE61)
PAIR = np.uint64(0xD1B54A32D192ED03)

UNIGRAM, BIGRAM, HISTORY = 1, 2, 3
SENT = "block int, kind int, part int, keys binary, counts binary, more binary"
ANSWER = "block int, kind int, part int, answer binary, owned binary, stats array<long>"
ARROW = {
    SENT: pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())]),
    ANSWER: pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("answer", pa.binary()), ("owned", pa.binary()), ("stats", pa.list_(pa.int64()))]),
}


def table_of(rows: list[tuple], kind: str) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in ARROW[kind]]
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, ARROW[kind], strict=True)], schema=ARROW[kind])


def small(counts: np.ndarray) -> bytes:
    """Counts in the narrowest type, named by the first byte."""
    kind = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def in_order(keys: np.ndarray, slots: np.ndarray, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys sorted, and slots into them where slots led into keys as they were."""
    order = np.argsort(keys) if order is None else order
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    return keys[order], place[slots]


class Block:
    """A block's tokens as numbers of its distinct words and pairs."""

    def __init__(self, table: pa.Table):
        self.ids, texts, held = unpacked(table, 3)
        self.held = np.array(held, bool)
        words: list[bytes] = []
        self.lengths = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = as_bytes(text).lower().split()
                self.lengths[i] = len(own)
                words += own
        hashes = word_hashes(words)
        ends = np.cumsum(self.lengths)
        tokens = np.insert(hashes, ends, END)
        self.lengths += 1
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        # distinct keys in the order of their mixed values, which is that of the parts
        slots, found = pd.factorize(np.concatenate([tokens, np.array([BEGIN])]))
        self.words, slots = in_order(mixed(found), slots)
        self.token = slots[:-1]
        self.begin = slots[-1]
        self.history = np.empty_like(self.token)
        self.history[1:] = self.token[:-1]
        self.history[self.starts] = self.begin
        n = len(self.words)
        slots, found = pd.factorize(self.history * n + self.token)
        histories, followers = found // n, found % n
        keys = mixed(self.words[histories] * PAIR + self.words[followers])
        order = np.argsort(keys)
        self.pairs, self.pair = in_order(keys, slots, order)
        self.pair_history, self.pair_token = histories[order], followers[order]
        self.train = ~np.repeat(self.held, self.lengths)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words and pairs; the mark before a text counts as history only."""
        words = np.bincount(self.token[self.train], minlength=len(self.words))
        return words, np.bincount(self.pair[self.train], minlength=len(self.pairs))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.zeros(0)


@dataclass
class Model:
    """Discounts and totals: what the whole corpus says in a few numbers."""

    tokens: int
    types: int
    documents: int
    unigram: np.ndarray  # discount by count, up to DISCOUNTED
    bigram: np.ndarray
    unseen: float = 1.0  # probability of all unseen words together
    scale: float = 0.0  # of a discounted count

    def known(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words by training count; all unseen words are one."""
        return np.where(counts > 0, self.scale * discounted(counts, self.unigram), self.unseen)


def discounted(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return counts * discounts[np.minimum(counts, len(discounts) - 1)]


def good_turing(seen: list[int]) -> np.ndarray:
    """Katz's discount of each count, from seen[r - 1] n-grams of count r.

    Counts above DISCOUNTED keep their value. Where the estimate is no proper
    discount (few n-grams of a count), half an occurrence is taken off.
    """
    k = DISCOUNTED
    out = np.ones(k + 2)
    out[0] = 0.0
    n = [0, *seen]
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def model_of(stats: dict[int, list[int]], documents: int) -> Model:
    """stats: for words and pairs, numbers of count 1 to DISCOUNTED + 1, of all, and the sum of counts."""
    width = DISCOUNTED + 1
    u, b = stats.get(UNIGRAM, [0] * (width + 2)), stats.get(BIGRAM, [0] * (width + 2))
    m = Model(u[width + 1], u[width], documents, good_turing(u[:width]), good_turing(b[:width]))
    if m.tokens:
        rest = m.tokens - sum(r * n for r, n in enumerate(u[:width], 1) if r <= DISCOUNTED)
        mass = sum(r * u[r - 1] * m.unigram[r] for r in range(1, DISCOUNTED + 1)) + rest
        m.unseen = max(1 - mass / m.tokens, 1 / (m.tokens + 1))
        m.scale = (1 - m.unseen) / mass
    else:
        m.unseen, m.scale = 1.0, 0.0
    return m


def add_up(table: pa.Table) -> pa.Table:
    """Total count of each key of each block, a mark, and the part's counts of counts.

    The mark tells of a pair that the block owns it, of a word that no other
    block has it.
    """
    d = table.to_pydict()
    kind, part = d["kind"][0], d["part"][0]
    keys = [expanded(x) for x in d["keys"]]
    sizes = [len(k) for k in keys]
    owner = np.repeat(np.array(d["block"]), sizes)
    every = np.concatenate(keys)
    counts = np.concatenate([wide(x) for x in d["counts"]])
    order = np.lexsort((owner, every))
    every = every[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    slot = np.cumsum(new) - 1
    total = np.bincount(slot, counts[order]).astype(np.int64)
    back, first = np.empty(len(every), np.int64), np.empty(len(every), bool)
    back[order], first[order] = total[slot], new if kind == BIGRAM else (np.bincount(slot) == 1)[slot]
    seen = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    stats = [*seen[1 : DISCOUNTED + 2].tolist(), int((total > 0).sum()), int(total.sum())]
    edges = np.cumsum(sizes)[:-1]
    return table_of(
        [(b, kind, part, small(x), np.packbits(f).tobytes(), stats if i == 0 else None) for i, (b, x, f) in enumerate(zip(d["block"], np.split(back, edges), np.split(first, edges), strict=True))],
        ANSWER,
    )


def add_histories(table: pa.Table) -> pa.Table:
    """The two sums of each history over all blocks."""
    d = table.to_pydict()
    part = d["part"][0]
    keys = [expanded(x) for x in d["keys"]]
    every, slot = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(slot, np.concatenate([np.frombuffer(x) for x in d[c]])) for c in ("counts", "more")]
    edges = np.cumsum([len(k) for k in keys])[:-1]
    return table_of([(b, HISTORY, part, x.tobytes(), y.tobytes(), None) for b, x, y in zip(d["block"], np.split(sums[0][slot], edges), np.split(sums[1][slot], edges), strict=True)], ANSWER)


def answers_of(table: pa.Table, kind: int) -> list[tuple[bytes, bytes]]:
    d = table.to_pydict()
    return [(a, o) for _, a, o in sorted((p, a, o) for k, p, a, o in zip(d["kind"], d["part"], d["answer"], d["owned"], strict=True) if k == kind)]


class Scorer:
    """A block with the corpus's counts of its words and pairs."""

    def __init__(self, block: Block, answers: pa.Table, model: Model):
        self.b, self.m = block, model
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        words = [(wide(a), o) for a, o in answers_of(answers, UNIGRAM)]
        self.c = joined([a for a, _ in words])
        self.alone = joined([np.unpackbits(np.frombuffer(o, np.uint8), count=len(a)) for a, o in words]).astype(bool)
        pairs = [(wide(a), o) for a, o in answers_of(answers, BIGRAM)]
        self.pair_c = joined([a for a, _ in pairs])
        self.owned = joined([np.unpackbits(np.frombuffer(o, np.uint8), count=len(a)) for a, o in pairs]).astype(bool)
        self.p = model.known(self.c)
        # how often each word stands before another; texts' ends never do
        self.as_history = self.c.copy()
        self.as_history[block.begin] = model.documents
        self.seen = self.pair_c > 0
        self.pair_mass = discounted(self.pair_c, model.bigram)

    def shares(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums of owned pairs by history: histories, their discounted counts and followers' probability; and which are complete here."""
        b = self.b
        use = self.seen & self.owned
        n = len(b.words)
        mass = np.bincount(b.pair_history[use], self.pair_mass[use], n)
        followers = np.bincount(b.pair_history[use], self.p[b.pair_token[use]], n)
        return np.flatnonzero(self.as_history > 0), mass, followers, self.alone

    def log_scores(self, mass: np.ndarray, followers: np.ndarray) -> np.ndarray:
        """log10 probability of each token: the pair's discounted share, or else backoff weight times the word's."""
        b = self.b
        seen = self.as_history > 0
        c = np.maximum(self.as_history, 1)
        # what discounting leaves, or one part in c + 1 where every pair is too frequent to be discounted
        left = 1 - mass / c
        floor = 1 / (c + 1)
        short = left < floor
        left = np.where(short, floor, left)
        scale = np.where(short, (1 - floor) * c / np.where(mass > 0, mass, 1), 1.0)
        alpha = np.where(seen, left / (1 - followers), 1.0)
        direct = scale[b.pair_history] * self.pair_mass / c[b.pair_history]
        return np.log10(np.where(self.seen, direct, alpha[b.pair_history] * self.p[b.pair_token]))[b.pair]


def katz_scores(df: DataFrame, folds: int = 10, fold: int = 0, text: str = "text") -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod folds is not fold; score all rows.

    Columns: doc_id, held_out boolean, n_tokens, n_known, train_tokens long,
    base_score and score double (log10). Tokens are the words of the text,
    A-Z lowered, and one end mark; a null or empty text is the mark alone.
    Repeated rows count each. All words unseen in training are one word, so both
    scores are over the same outcomes; a history unseen in training leaves the
    word's own probability. Without training rows every score is 0.
    """
    n = block_count(df, text, CHARS)
    held = (id_bucket(F.col("doc_id"), folds) == fold).alias("held")
    docs = scattered(df, n, text, (held,))
    per_block = CHARS / 6
    parts = {UNIGRAM: part_count(n * per_block / 4), BIGRAM: part_count(n * per_block), HISTORY: part_count(n * per_block / 4)}

    def number(t: pa.Table) -> int:
        return t.column("block")[0].as_py()

    def send(t: pa.Table) -> pa.Table:
        b = Block(t)
        rows = []
        for kind, keys, counts in zip((UNIGRAM, BIGRAM), (b.words, b.pairs), b.counts(), strict=True):
            rows += [(number(t), kind, p, squeezed(keys[x:y]), small(counts[x:y]), None) for p, x, y in cut(keys, parts[kind])]
        return table_of(rows, SENT)

    counted = stored(docs.groupBy("block").applyInArrow(send, SENT).groupBy("kind", "part").applyInArrow(add_up, ANSWER), "ngrams")
    width = DISCOUNTED + 3
    sums = counted.where("stats is not null").groupBy("kind").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(width)]).collect()
    documents = df.where(~(id_bucket(F.col("doc_id"), folds) == fold)).count()
    model = model_of({r["kind"]: [r[f"s{i}"] for i in range(width)] for r in sums}, documents)

    def share(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table_of([], SENT)
        s = Scorer(Block(t), answers, model)
        histories, mass, followers, complete = s.shares()
        histories = histories[~complete[histories]]
        keys, mass, followers = s.b.words[histories], mass[histories], followers[histories]
        return table_of([(number(t), HISTORY, p, squeezed(keys[x:y]), mass[x:y].tobytes(), followers[x:y].tobytes()) for p, x, y in cut(keys, parts[HISTORY])], SENT)

    plain = counted.drop("stats").withColumn("stats", F.lit(None).cast("array<long>"))
    summed = docs.groupBy("block").cogroup(plain.groupBy("block")).applyInArrow(share, SENT).groupBy("part").applyInArrow(add_histories, ANSWER)
    schema = StructType([df.schema["doc_id"], *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])
    arrow = to_arrow_schema(schema)

    def score(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_arrays([pa.array([], type=f.type) for f in arrow], schema=arrow)
        b = Block(t)
        s = Scorer(b, answers, model)
        histories, mass, followers, complete = s.shares()
        remote = histories[~complete[histories]]
        got = answers_of(answers, HISTORY)
        if got:
            mass[remote] = np.concatenate([np.frombuffer(a) for a, _ in got])
            followers[remote] = np.concatenate([np.frombuffer(o) for _, o in got])
        counts = s.c[b.token]
        base = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
        columns = [b.ids, b.held.tolist(), b.lengths.tolist(), b.sums((counts > 0).astype(np.int64)).tolist(), [model.tokens] * len(b.ids), b.sums(base).tolist(), b.sums(s.log_scores(mass, followers)).tolist()]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    answers = plain.unionByName(summed)
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
