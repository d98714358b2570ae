"""Searches that skip what a bound rules out: lexical top-k, late interaction, and lookups among earlier vectors.

Every one is exact: what a bound leaves is scored in full. Queries and corpus
are packed in blocks of bounded size; a block of queries meets a block of the
corpus in one row, so no word and no query gathers its rows in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as T
from ..session import stored

#: Documents in a shard of postings or a block of token vectors, queries in a block, vectors in a block of a log.
SHARD, QUERIES, LOG = 4096, 512, 1024
#: One shard in PILOT is searched first.
PILOT = 8
#: Centroids of token vectors and pivots of a log, and the sample from which they come.
CENTRES, SAMPLE = 64, 4096
#: Scores are rounded to DIGITS; a bound must be lower by more than MARGIN to rule anything out.
DIGITS, MARGIN = 6, 2e-6


def meet(held: DataFrame, asked: DataFrame, places: int) -> DataFrame:
    """Each row of held (blocks of a corpus, with a number "block") beside each row of asked (blocks of queries).

    A block of the corpus goes to one of the places, the queries to all.
    """
    everywhere = asked.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
    return held.withColumn("_place", F.pmod("block", F.lit(places)).cast("int")).join(everywhere, "_place").drop("_place")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest rounded scores, ties by id."""
    return np.lexsort((ids, -scores))[:k]


def top_rows(found: DataFrame, k: int, score: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# ---- lexical


def lexical_rows(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score of each shard's best rows, and met: how many of its documents the query touched.

    met stands on the first row of a query in a shard only.
    """
    n = max(1, corpus.count())
    asked = stored(queries.where("id is not null").select(F.col("id").cast("long").alias("query_id"), F.explode(T.word_set(F.col("text"))).alias("word")).distinct(), "asked")
    postings = corpus.where("id is not null").select(F.col("id").cast("long").alias("doc_id"), F.explode(T.words(F.col("text"))).alias("word"))
    counted = stored(postings.join(asked.select("word").distinct(), "word", "left_semi").groupBy("doc_id", "word").agg(F.count("*").alias("tf")), "postings")
    idf = counted.groupBy("word").agg(F.log(1 + F.lit(float(n)) / F.count("*")).alias("idf"))
    # at least k documents hold the word as often as its k-th most frequent one, so a query's k-th score is not below that impact
    w = Window.partitionBy("word").orderBy(F.desc("tf"))
    often = counted.groupBy("word", "tf").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(w)).where(F.col("upto") >= k)
    kth = often.groupBy("word").agg(F.max("tf").alias("kth"))
    terms = stored(idf.join(kth, "word", "left").select("word", "idf", F.coalesce((1 + F.log("kth")) * F.col("idf"), F.lit(0.0)).alias("sure")), "terms")

    shards = math.ceil(n / SHARD)
    weighed = counted.join(terms.select("word", "idf"), "word").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("block"), "doc_id", F.xxhash64("word").alias("term"), ((1 + F.log("tf")) * F.col("idf")).alias("impact")
    )

    def index(t: pa.Table) -> pa.Table:
        docs, doc = np.unique(t.column("doc_id").to_numpy(), return_inverse=True)
        words, term = np.unique(t.column("term").to_numpy(), return_inverse=True)
        order = np.lexsort((doc, term))
        starts = np.searchsorted(term[order], np.arange(len(words) + 1))
        impact = t.column("impact").to_numpy()[order]
        most = np.maximum.reduceat(impact, starts[:-1])
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32())} | {name: pa.array([x.tobytes()], pa.binary()) for name, x in (("docs", docs), ("words", words), ("starts", starts.astype(np.int64)), ("doc", doc[order].astype(np.int32)), ("impact", impact), ("most", most))})

    held = weighed.groupBy("block").applyInArrow(index, "block int, docs binary, words binary, starts binary, doc binary, impact binary, most binary")
    blocks = max(1, math.ceil(asked.agg(F.count_distinct("query_id")).first()[0] / QUERIES))
    known = asked.join(terms.select("word", "sure"), "word").select(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("q"), "query_id", F.xxhash64("word").alias("term"), "sure")

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("query_id").to_numpy(), kind="stable")
        own = t.column("query_id").to_numpy()[order]
        ids, starts = np.unique(own, return_index=True)
        least = np.maximum.reduceat(t.column("sure").to_numpy()[order], starts)
        columns = (("ids", ids), ("edges", np.append(starts, len(own)).astype(np.int64)), ("terms", t.column("term").to_numpy()[order]), ("least", least))
        return pa.table({name: pa.array([x.tobytes()], pa.binary()) for name, x in columns})

    packing = lambda df: df.groupBy("q").applyInArrow(pack, "ids binary, edges binary, terms binary, least binary")
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64()), ("met", pa.int64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                read = lambda name, kind, row=row: np.frombuffer(row[name], kind)
                docs, words, starts, doc, impact, most = read("docs", np.int64), read("words", np.int64), read("starts", np.int64), read("doc", np.int32), read("impact", np.float64), read("most", np.float64)
                ids, edges, terms, least = read("ids", np.int64), read("edges", np.int64), read("terms", np.int64), read("least", np.float64)
                at = np.minimum(np.searchsorted(words, terms), len(words) - 1)
                bound = np.where(words[at] == terms, most[at], 0.0)
                whole = np.add.reduceat(bound, edges[:-1])
                out = []
                for q in np.flatnonzero(whole >= np.maximum(least - MARGIN, 1e-300)).tolist():
                    mine = slice(edges[q], edges[q + 1])
                    order = np.argsort(-bound[mine], kind="stable")
                    b, a = bound[mine][order], at[mine][order]
                    rest = np.append(np.cumsum(b[::-1])[::-1], 0.0)  # what the terms from each on can add
                    total, seen = np.zeros(len(docs)), np.zeros(len(docs), bool)
                    near, sure = None, least[q]  # sure: a score that k documents reach, here or elsewhere
                    for i in np.flatnonzero(b > 0).tolist():
                        own = slice(starts[a[i]], starts[a[i] + 1])
                        if near is None and seen.sum() >= k:
                            sure = max(sure, np.partition(total, -k)[-k])
                        if near is None and rest[i] < sure - MARGIN:
                            near = seen.copy()  # a document first met from here on can't reach the k best
                        if near is None:
                            seen[doc[own]] = True
                            total[doc[own]] += impact[own]
                        else:
                            there = near[doc[own]]
                            total[doc[own][there]] += impact[own][there]
                    hit = np.flatnonzero(seen & (total >= sure - MARGIN))
                    scores = np.round(total[hit], DIGITS)
                    first = best(scores, docs[hit], k)
                    met = np.zeros(max(1, len(first)), np.int64)
                    met[0] = int(seen.sum())
                    none = not len(first)
                    out.append((np.full(len(met), ids[q]), np.array([-1]) if none else docs[hit[first]], np.array([np.nan]) if none else scores[first], met))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    held = stored(held, "shards")
    search = lambda shard, asked: meet(held.where(shard), packing(asked), max(1, shards)).mapInArrow(score, "query_id long, doc_id long, score double, met long")
    # some shards go first; the k-th best score there is sure for all others
    first = F.col("block") % PILOT == 0
    pilot = stored(search(first, known), "pilot")
    found = top_rows(pilot.where("not isnan(score)"), k, "score").where(F.col("rank") == k).select("query_id", F.col("score").alias("reached"))
    raised = known.join(found, "query_id", "left").withColumn("sure", F.greatest("sure", F.coalesce("reached", F.lit(0.0)))).drop("reached")
    return pilot.unionByName(search(~first, raised))


def lexical_top(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank by TF-IDF: sum over shared words of (1 + ln tf) * ln(1 + N / df).

    Both have (id, text); rows without an id take no part, ids are integers and
    told apart. Postings of the queries' words lie in shards of about SHARD
    documents with each word's greatest impact there. A query knows from the
    start a score that k documents reach, and a better one from the shards that are
    searched first; shards whose words can't add up to it are skipped, and inside a shard only documents that hold one of the words
    without which it can't be reached are looked at.
    """
    return top_rows(lexical_rows(queries, corpus, k).where("not isnan(score)").drop("met"), k, "score")


# ---- late interaction


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows without length stay zero."""
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def centres_of(vectors: np.ndarray, centres: int = CENTRES, rounds: int = 3) -> np.ndarray:
    """Unit centroids of a bounded sample of unit vectors."""
    own = vectors[:: max(1, len(vectors) // centres)][:centres].copy()
    for _ in range(rounds):
        code = (vectors @ own.T).argmax(axis=1)
        total = np.zeros_like(own)
        np.add.at(total, code, vectors)
        own = np.where((total != 0).any(axis=1, keepdims=True), unit(total), own)
    return own


def token_sample(corpus: DataFrame) -> np.ndarray:
    """Token vectors of at most SAMPLE rows, those of least hash of id; they shape the index, not the results."""
    rows = corpus.where("id is not null and size(vectors) > 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE // 4).select(F.col("vectors").cast("array<array<double>>").alias("v")).collect()
    every = [v for r in rows for v in r.v if v is not None and None not in v]
    width = len(every[0]) if every else 1
    return unit(np.array([v for v in every if len(v) == width][:SAMPLE], np.float64).reshape(-1, width))


def packed_tokens(df: DataFrame, rows: int, width: int) -> DataFrame:
    """block, ids, edges, tokens: rows of df (id, vectors) in blocks as they come, token vectors scaled; no shuffle.

    Vectors that are null, hold null or have another width count as zero.
    """
    x = F.transform(F.coalesce("vectors", F.array().cast("array<array<double>>")), lambda v: F.when(F.size(v) == width, F.transform(v.cast("array<double>"), lambda y: F.coalesce(y, F.lit(0.0)))).otherwise(F.array_repeat(F.lit(0.0), width)))
    source = df.where("id is not null").select(F.col("id").cast("long").alias("id"), F.size(x).alias("n"), F.flatten(x).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                ids = part.column(0).to_numpy()
                edges = np.concatenate([[0], np.cumsum(part.column(1).to_numpy())]).astype(np.int64)
                tokens = unit(part.column(2).flatten().to_numpy().reshape(-1, width))
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[0])])] + [pa.array([a.tobytes()], pa.binary()) for a in (ids, edges, tokens)], names=["block", "ids", "edges", "tokens"])

    return source.mapInArrow(run, "block long, ids binary, edges binary, tokens binary")


def token_index(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """packed_tokens with codes, the nearest centroid of each token, and spread, the largest angle to each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens = np.frombuffer(batch.column(3)[i].as_py(), np.float64).reshape(-1, centres.shape[1])
                near = tokens @ centres.T
                code = near.argmax(axis=1) if len(tokens) else np.zeros(0, np.int64)
                spread = np.zeros(len(centres))
                np.maximum.at(spread, code, np.arccos(np.clip(near[np.arange(len(code)), code], -1, 1)))
                extra = [pa.array([a.tobytes()], pa.binary()) for a in (code.astype(np.uint8), spread)]
                yield pa.RecordBatch.from_arrays([batch.column(j).slice(i, 1) for j in range(4)] + extra, names=["block", "ids", "edges", "tokens", "codes", "spread"])

    return packed_tokens(corpus, SHARD, centres.shape[1]).mapInArrow(run, "block long, ids binary, edges binary, tokens binary, codes binary, spread binary")


def by_row(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The largest value of each row's tokens along the last axis, 0 at least and for rows without tokens."""
    out = np.zeros((len(values), len(edges) - 1))
    full = np.flatnonzero(np.diff(edges))
    if len(full):
        out[:, full] = np.maximum.reduceat(values, edges[full], axis=1)
    return np.maximum(out, 0)


def multi_vector_rows(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, max_sim of each block's best rows, and scored: how many of its rows were scored in full.

    scored stands on the first row of a query in a block only.
    """
    sample = token_sample(corpus)
    centres = centres_of(sample) if len(sample) else np.zeros((1, 1))
    index = stored(token_index(corpus, centres), "token-index")
    asked = packed_tokens(queries, QUERIES, centres.shape[1])
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("max_sim", pa.float64()), ("scored", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                read = lambda name, kind, row=row: np.frombuffer(row[name], kind)
                ids, edges, codes, spread = read("ids", np.int64), read("edges", np.int64), read("codes", np.uint8), read("spread", np.float64)
                tokens, own = (read(name, np.float64).reshape(-1, centres.shape[1]) for name in ("tokens", "q_tokens"))
                own_ids, own_edges = read("q_ids", np.int64), read("q_edges", np.int64)
                angle = np.arccos(np.clip(own @ centres.T, -1, 1)) - spread
                table = np.where((own != 0).any(axis=1, keepdims=True), np.cos(np.maximum(angle, 0)), 0.0) + 1e-9
                sizes = np.diff(edges)
                out = []
                for q in range(len(own_ids)):
                    mine = slice(own_edges[q], own_edges[q + 1])
                    m = max(1, own_edges[q + 1] - own_edges[q])
                    bound = by_row(table[mine][:, codes], edges).sum(axis=0) / m
                    bound[ids == own_ids[q]] = -1
                    score = np.full(len(ids), -1.0)

                    def fill(rows: np.ndarray, mine=mine, m=m, score=score) -> None:
                        places = np.repeat(edges[rows], sizes[rows]) + np.arange(sizes[rows].sum()) - np.repeat(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows])
                        score[rows] = by_row(own[mine] @ tokens[places].T, np.concatenate([[0], np.cumsum(sizes[rows])])).sum(axis=0) / m

                    first = np.argpartition(-bound, min(4 * k, len(bound) - 1))[: 4 * k]
                    fill(first[bound[first] >= 0])
                    kth = np.partition(score, -min(k, len(score)))[-min(k, len(score))]
                    fill(np.flatnonzero((score < 0) & (bound >= max(0.0, kth - MARGIN))))
                    held = np.flatnonzero(score >= 0)
                    scores = np.round(score[held], DIGITS)
                    top = best(scores, ids[held], k)
                    if len(top):
                        scored = np.zeros(len(top), np.int64)
                        scored[0] = len(held)
                        out.append((np.full(len(top), own_ids[q]), ids[held][top], scores[top], scored))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    named = asked.select(F.col("ids").alias("q_ids"), F.col("edges").alias("q_edges"), F.col("tokens").alias("q_tokens"))
    places = max(1, index.count())
    return meet(index.withColumn("block", F.abs(F.xxhash64("block") % places)), named, places).mapInArrow(search, "query_id long, doc_id long, max_sim double, scored long")


def multi_vector_search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, max_sim, rank: the k rows of corpus with the largest late interaction, but for the query's own.

    Both have (id, vectors array<array<float>>); max_sim is the mean over a
    query's vectors of the largest cosine with one of the row's, 0 at least.
    The index knows each token's centroid and, for each block and centroid, the
    largest angle between them; the triangle inequality of angles bounds every
    row's score, and only rows whose bound reaches the k-th best score are
    scored in full. Rows without an id take no part; ties go by id.
    """
    return top_rows(multi_vector_rows(queries, corpus, k).drop("scored"), k, "max_sim")


# ---- earlier vectors


def log_blocks(log: DataFrame, ttl: float) -> DataFrame:
    """The vectors of a log, scaled, in blocks of one window of ttl and one pivot's cell, with centre, radius and times.

    Pivots are CENTRES vectors of least hash. A window's cell of any size is cut
    in as many blocks as it needs, by time.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.col("id").isNotNull() & F.col("ts").isNotNull() & F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v)) & F.exists(x, lambda v: v != 0), F.lit(False))
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    rows = log.where(sound).select(F.col("id").cast("long").alias("id"), F.col("ts").cast("double").alias("ts"), F.size(x).alias("width"), F.transform(x, lambda v: v / length).alias("x"))
    some = rows.orderBy(F.xxhash64("id"), "id", "ts").limit(CENTRES).collect()
    pivots: dict[int, list] = {}
    for r in some:
        pivots.setdefault(r.width, []).append(r.x)
    books = {w: np.array(p) for w, p in pivots.items()}
    celled = StructType([*rows.schema.fields, StructField("cell", IntegerType())])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(2).to_numpy()
            cell = np.zeros(batch.num_rows, np.int32)
            values, edges = batch.column(3).values.to_numpy(), batch.column(3).offsets.to_numpy()
            for w, book in books.items():
                at = np.flatnonzero(widths == w)
                if len(at):
                    cell[at] = (values[edges[at][:, None] + np.arange(w)] @ book.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    placed = rows.mapInArrow(cells, celled).withColumn("window", F.floor(F.col("ts") / ttl).cast("long"))
    order = ["window", "width", "cell", "ts", "id"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, "x", F.spark_partition_id().alias("part"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            key = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                for at in range(begin, end, LOG):
                    part = batch.slice(at, min(LOG, end - at))
                    x = part.column(5).flatten().to_numpy().reshape(part.num_rows, -1)
                    ts, ids = part.column(3).to_numpy(), part.column(4).to_numpy()
                    centre = x.mean(axis=0)
                    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) + 1e-9
                    number = (part.column(6)[0].as_py() << 32) + count
                    count += 1
                    row = (number, int(key[at, 0]), int(key[at, 1]), centre.tolist(), radius, float(ts[0]), float(ts[-1]), ids.tobytes(), ts.tobytes(), x.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, BLOCK, strict=True)], schema=BLOCK)

    return dealt.mapInArrow(pack, "block long, window long, width int, centre array<double>, radius double, since double, upto double, ids binary, times binary, vectors binary")


BLOCK = pa.schema(
    [("block", pa.int64()), ("window", pa.int64()), ("width", pa.int32()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("since", pa.float64()), ("upto", pa.float64())]
    + [(c, pa.binary()) for c in ("ids", "times", "vectors")]
)


def block_pairs(blocks: DataFrame, threshold: float, ttl: float) -> DataFrame:
    """asked, held: the pairs of blocks that can hold a match, by time and by the triangle inequality of their balls."""
    meta = blocks.select("block", "window", "width", "centre", "radius", "since", "upto")
    asked = meta.select(*[F.col(c).alias(f"q_{c}") for c in meta.columns], F.explode(F.array("window", F.col("window") - 1)).alias("window"))
    near = (F.col("since") < F.col("q_upto")) & (F.col("upto") >= F.col("q_since") - ttl) & (F.col("width") == F.col("q_width"))
    apart = F.sqrt(F.aggregate(F.zip_with("centre", "q_centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6  # the farthest that unit vectors of this cosine can be apart
    return asked.join(meta, "window").where(near).where(apart <= F.col("radius") + F.col("q_radius") + chord).select(F.col("q_block").alias("asked"), F.col("block").alias("held"))


def similar_before(log: DataFrame, threshold: float = 0.95, ttl: float = 3600.0) -> DataFrame:
    """id, ts, hit, score: for each row of log (id, ts, embedding) the most similar earlier one, if it is similar enough.

    Earlier means ts less by more than 0 and at most ttl. score is the cosine,
    rounded to six digits, of at least threshold; ties go to the earliest, then
    the least id. Rows without id, ts or a vector with a length take no part, and
    vectors of different widths do not meet. Repeated rows answer alike.
    """
    blocks = stored(log_blocks(log, ttl), "log-blocks")
    pairs = block_pairs(blocks, threshold, ttl)
    side = lambda p: blocks.select(F.col("block").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("ids", "times", "vectors")])
    met = pairs.join(side("held"), "held").join(side("asked"), "asked").select(*[f"{p}_{c}" for p in ("asked", "held") for c in ("ids", "times", "vectors")])
    names = ["id", "ts", "hit", "hit_ts", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(j)[i].as_py() for j in range(6)]
                ids, times, x, own, when, y = (np.frombuffer(r, k) for r, k in zip(raw, [np.int64, np.float64, np.float64] * 2, strict=True))
                score = np.round(x.reshape(len(ids), -1) @ y.reshape(len(own), -1).T, DIGITS)
                ago = times[:, None] - when[None]
                score[(ago <= 0) | (ago > ttl) | (score < threshold)] = -2
                order = np.lexsort((own, when))
                at = order[score[:, order].argmax(axis=1)]  # the earliest of equals
                hit = np.flatnonzero(score[np.arange(len(ids)), at] >= threshold)
                columns = (ids[hit], times[hit], own[at[hit]], when[at[hit]], score[hit, at[hit]])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    found = met.mapInArrow(run, "id long, ts double, hit long, hit_ts double, score double")
    first = F.struct((-F.col("score")).alias("minus"), "hit_ts", "hit")
    return found.groupBy("id", "ts").agg(F.min(first).alias("x")).select("id", "ts", F.col("x.hit").alias("hit"), (-F.col("x.minus")).alias("score"))


# ---- the first earlier vector that is near enough

#: Blocks of a key that meet at one place; who asks them is sent to every place of the key.
COPY = 32


def vector_blocks(rows: DataFrame, most: int) -> DataFrame:
    """key, width, first, last, n, ids, vectors, block: rows (key, width, id, embedding) in order of id, most of them in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids, vectors = None, np.zeros(0, np.int64), np.zeros((0, 1), np.float32)

        def block(n: int) -> pa.RecordBatch:
            made = {"key": own[0], "width": own[1], "first": ids[0], "last": ids[n - 1], "n": n, "ids": ids[:n].tobytes(), "vectors": vectors[:n].tobytes()}
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made.values(), kinds, strict=True)], names=list(made))

        for batch in batches:
            keys, widths = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            new, flat = batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy()
            spots = np.r_[0, np.cumsum(widths, dtype=np.int64)]
            edges = [i for i in range(len(keys)) if i == 0 or (keys[i], widths[i]) != (keys[i - 1], widths[i - 1])] + [len(keys)]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                this = keys[begin], int(widths[begin])
                if this != own:
                    if len(ids):
                        yield block(len(ids))
                    own, ids, vectors = this, ids[:0], np.zeros((0, this[1]), np.float32)
                ids = np.concatenate([ids, new[begin:end]])
                vectors = np.concatenate([vectors, flat[spots[begin] : spots[end]].reshape(-1, own[1])])
                while len(ids) >= most:
                    yield block(most)
                    ids, vectors = ids[most:], vectors[most:]
        if len(ids):
            yield block(len(ids))

    order = ["key", "width", "id"]
    sorted_ = rows.select(*order, "embedding").repartitionByRange(*order).sortWithinPartitions(*order)
    made = sorted_.mapInArrow(run, "key string, width int, first long, last long, n long, ids binary, vectors binary")
    return stored(made.withColumn("block", F.monotonically_increasing_id()), "vector-blocks")


def first_within(df: DataFrame, threshold: float, most: int = LOG) -> DataFrame:
    """id, hit: for each row of df (id, key, embedding) the least smaller id of the same key with a dot product of at least threshold.

    Products are rounded to six digits. Only rows with an answer are returned;
    rows without id, key or a whole vector take no part, and vectors of
    different widths do not meet.

    Each key's rows lie in blocks by id. All blocks ask the key's head, its first
    rows: what is found there is the answer, as all others have larger ids. Rows
    that the head doesn't answer ask every later block, equal vectors once: time
    grows with their square, memory doesn't.
    """
    bound = threshold - 0.5 * 10.0**-DIGITS
    sound = F.col("id").isNotNull() & F.col("key").isNotNull() & F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()), F.lit(False))
    rows = df.where(sound).select(F.col("id").cast("long").alias("id"), "key", F.size("embedding").alias("width"), F.col("embedding").cast("array<float>").alias("embedding"))
    blocks = vector_blocks(rows, most)
    keys = ["key", "width"]
    w = Window.partitionBy(*keys)
    before = F.sum("n").over(w.orderBy("first", "block")) - F.col("n")
    places = blocks.select(*keys, "first", "n", "block").select("block", (before < most).alias("head"), F.ceil(F.count("*").over(w) / COPY).cast("int").alias("copies"))
    placed = blocks.join(places, "block").withColumn("place", F.pmod(F.xxhash64("block"), F.col("copies")).cast("int"))
    heads = placed.where("head").groupBy(*keys).agg(F.collect_list(F.struct("ids", "vectors")).alias("heads"), F.max("copies").alias("copies"))
    heads = heads.select(*keys, "heads", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("place"))
    met = placed.join(heads, [*keys, "place"])

    def matrix(vectors: bytes, width: int) -> np.ndarray:
        return np.frombuffer(vectors, np.float32).reshape(-1, width).astype(np.float64)

    def ask_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, width, ids, vectors, held = (batch.column(j)[i].as_py() for j in range(5))
                ids, x = np.frombuffer(ids, np.int64), matrix(vectors, width)
                own = np.concatenate([np.frombuffer(h["ids"], np.int64) for h in held])
                order = np.argsort(own, kind="stable")
                own, y = own[order], np.concatenate([matrix(h["vectors"], width) for h in held])[order]
                near = ~(x @ y.T < bound) & (own[None] < ids[:, None])
                at = near.argmax(axis=1)
                hit = near[np.arange(len(ids)), at]
                left = ~hit & (ids > own[-1])  # no other row has all the earlier ones in the head
                told = np.flatnonzero(hit | left)
                empty = np.where(left[told], width, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(empty)], pa.int32()), pa.array(x[left].astype(np.float32).ravel()))
                columns = [pa.array(ids[told]), pa.array(own[at[told]], mask=left[told]), pa.array([key] * len(told), pa.string()), pa.array([width] * len(told), pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "hit", "key", "width", "embedding"])

    asked = met.select(*keys, "ids", "vectors", "heads").mapInArrow(ask_head, "id long, hit long, key string, width int, embedding array<float>")
    asked = stored(asked, "asked-heads")
    left = asked.where("hit is null").drop("hit")
    # the first row near a vector is that of all its copies, if it comes before them
    alike = left.groupBy(*keys, "embedding").agg(F.max("id").alias("id"))
    asking = vector_blocks(alike, most).select(*keys, F.col("last").alias("until"), F.col("vectors").alias("own"))
    asking = asking.join(placed.select(*keys, "place").distinct(), keys)
    met = asking.join(placed.where("not head"), [*keys, "place"]).where("first < until").select(*keys, "own", "ids", "vectors")

    def ask_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, width, own, ids, vectors = (batch.column(j)[i].as_py() for j in range(5))
                x, ids = np.frombuffer(own, np.float32).reshape(-1, width), np.frombuffer(ids, np.int64)
                near = ~(x.astype(np.float64) @ matrix(vectors, width).T < bound)
                hit = near.any(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hit.sum() + 1) * width, pa.int32()), pa.array(x[hit].ravel()))
                n = len(lists)
                columns = [pa.array([key] * n, pa.string()), pa.array([width] * n, pa.int32()), lists, pa.array(ids[near[hit].argmax(axis=1)] if n else ids[:0])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "width", "embedding", "hit"])

    later = met.mapInArrow(ask_all, "key string, width int, embedding array<float>, hit long").groupBy(*keys, "embedding").agg(F.min("hit").alias("hit"))
    late = left.join(later, [*keys, "embedding"]).where("hit < id").select("id", "hit")
    return asked.where("hit is not null").select("id", "hit").unionByName(late).groupBy("id").agg(F.min("hit").alias("hit"))
