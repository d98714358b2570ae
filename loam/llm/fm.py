"""Operator 10: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import beside_texts, hold, id_bucket, map_texts, memory

#: Buckets of hashed words, steps of each structure statistic, and width of the factors.
WORD_BUCKETS, STEPS, FACTORS = 1 << 14, 32, 8
#: Most labelled rows that the fit uses: those of least hash of their identifier.
SAMPLE = 8192
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 128, 0.05, 1e-6, 7

MEMORY = 200_000
WORD_WEIGHT = 1.0

SYMBOLS = "#*$%&|<>@^~{}[]\\/_=+"
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGIT = re.compile(r"[0-9]")


def statistics(text: str, words: list[bytes]) -> list[float]:
    """Structure and metadata of a text, each in [0, 1]."""
    n = len(words)
    chars = max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda a, b: min(1.0, a / b) if b else 0.0
    return [
        min(1.0, np.log1p(n) / 12),
        min(1.0, np.log1p(len(text)) / 14),
        share(sum(map(text.count, SYMBOLS)), chars),
        share(len(UPPER.findall(text)), chars),
        share(len(DIGIT.findall(text)), chars),
        share(text.count("!"), chars / 4),
        share(text.count("."), chars / 8),
        share(text.count(","), chars / 8),
        share(text.count("|"), max(1, n)),
        share(len(lines) - len(set(lines)), len(lines)),
        share(n - len(set(words)), n),
        share(sum(map(len, words)), 16 * n),
        share(n, 64 * max(1, len(lines))),
        share(text.count("http") + text.count("www."), 1 + n / 64),
    ]


N_STATISTICS = 14
SIZE = WORD_BUCKETS + N_STATISTICS * STEPS + 1  # and one feature of texts without words

_buckets: dict[bytes, int] = memory("buckets")


def bucket(word: bytes) -> int:
    b = _buckets.get(word)
    if b is None:
        if len(_buckets) > MEMORY:
            _buckets.clear()
        b = zlib.crc32(word.lower().strip(b".,;:!?\"'()")) & WORD_BUCKETS - 1
        if len(word) < 64:
            _buckets[word] = b
    return b


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices, ascending and distinct, and values of a text's features, at most SIZE however long it is."""
    hold("buckets")
    words = text.encode("utf-8", "replace").split()
    places = [min(STEPS - 1, int(x * STEPS)) + WORD_BUCKETS + i * STEPS for i, x in enumerate(statistics(text, words))]
    if not words:
        places.append(SIZE - 1)
    at, times = np.unique(np.fromiter(map(bucket, words), np.int64, len(words)), return_counts=True)
    size = np.sqrt(float((times * times).sum())) or 1.0
    return np.concatenate([at, places]), np.concatenate([WORD_WEIGHT * times / size, np.ones(len(places))])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        """bias + w x + sum over pairs of <v_i, v_j> x_i x_j.

        The pairs are half of (sum v x) squared minus sum of (v x) squared, so
        the cost is linear in the number of features.
        """
        vx = self.factors[at] * x[:, None]
        total = vx.sum(axis=0)
        return self.bias + float(self.weights[at] @ x) + 0.5 * float(total @ total - (vx * vx).sum())

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*features(text)), -35, 35))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], wanted: np.ndarray) -> Machine:
    """Logistic loss, adaptive gradient steps over shuffled batches; the same rows give the same machine."""
    rng = np.random.default_rng(SEED)
    w = np.zeros(SIZE)
    v = rng.normal(0, 0.02, (SIZE, FACTORS))
    share = min(max(float(wanted.mean()) if len(wanted) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    sum_w, sum_v, sum_b = np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-6), 1e-6
    for _ in range(EPOCHS if len(rows) else 0):
        order = rng.permutation(len(rows))
        for begin in range(0, len(rows), BATCH):
            part = order[begin : begin + BATCH]
            at = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            lengths = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx = v[at] * x[:, None]
            total = np.add.reduceat(vx, starts)
            raw = bias + np.add.reduceat(w[at] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - wanted[part]) / len(part)
            each = np.repeat(error, lengths) * x
            used, slot = np.unique(at, return_inverse=True)
            gw = np.bincount(slot, each, len(used)) + DECAY * w[used]
            gv_rows = each[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            gv = np.stack([np.bincount(slot, gv_rows[:, f], len(used)) for f in range(FACTORS)], axis=1) + DECAY * v[used]
            sum_w[used] += gw * gw
            sum_v[used] += gv * gv
            w[used] -= RATE * gw / np.sqrt(sum_w[used])
            v[used] -= RATE * gv / np.sqrt(sum_v[used])
            gb = float(error.sum())
            sum_b += gb * gb
            bias -= RATE * gb / np.sqrt(sum_b)
    return Machine(bias, w.astype(np.float32), v.astype(np.float32))


def train(df: DataFrame, labelled: DataFrame, sample: int = SAMPLE, text: str = "text") -> Machine:
    """Fit on at most sample labelled rows that are not held out.

    labelled has doc_id and quality (0 or 1; other values are left out; the
    first of repeated identifiers by value counts). Chosen are those of least
    hash of doc_id, so the choice does not hang on partitions; of rows of df
    with one doc_id, the least text counts. Features are made on the executors
    from whole texts; at most sample rows of at most SIZE features reach the
    driver. Without usable rows the machine scores every text one half.
    """
    usable = labelled.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (id_bucket(F.col("doc_id"), 4) != 2))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(sample)
    wanted = {r["doc_id"]: r["quality"] for r in chosen.collect()}
    if not wanted:
        return Machine(0.0, np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32))
    spark = df.sparkSession
    ids = spark.createDataFrame([(i,) for i in wanted], chosen.select("doc_id").schema)
    rows = df.select("doc_id", text).join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(text).alias(text))

    def run(texts: list[str]) -> list[list]:
        made = [features(t) for t in texts]
        return [[a.astype("<u2").tobytes() for a, _ in made], [x.astype("<f4").tobytes() for _, x in made]]

    got = sorted(map_texts(rows, run, "at binary, x binary", ("doc_id",), text).collect())
    pairs = [(np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(np.float64)) for r in got]
    return fit(pairs, np.array([wanted[r["doc_id"]] for r in got], dtype=float))


def classify(df: DataFrame, machine: Machine, keep: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "score") -> DataFrame:
    """keep and a score (0 to 1) of each text; null reads as empty. The machine, of fixed size, is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    return map_texts(df, lambda texts: [list(map(shared.value.score, texts))], f"{out} double", keep, text)


def accepted(df: DataFrame, machine: Machine, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of df whose text scores threshold or more, with all their columns, whatever their names."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    scored = beside_texts(df, lambda texts: [list(map(shared.value.score, texts))], "score double", tuple(df.columns), text)
    return scored.where(F.col("score") >= threshold).select(*[F.col("kept").getField(c).alias(c) for c in df.columns])


def quality_scores(df: DataFrame, labelled: DataFrame, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """Fit on labelled rows and score every row: doc_id, held_out, score, predicted.

    held_out rows (crc32 of doc_id mod 4 is 2) never enter the fit; labels,
    language, source and identifier are no inputs of a score, so equal texts
    get equal scores. A null or empty text is scored by its lack of words; a
    null doc_id counts as empty text for held_out; a score equal to threshold
    predicts 1. Repeated rows are scored each; other columns are left out.
    """
    machine = train(df, labelled, text=text)
    scored = classify(df, machine, text=text)
    return scored.select(
        "doc_id",
        (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
