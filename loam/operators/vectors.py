"""Dense and lexical search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows in a block of queries and of a corpus.
QUERY_BLOCK, CORPUS_BLOCK = 2048, 8192

Transform = Callable[[DataFrame], DataFrame]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def top_k(df: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank, ties by identifier."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def packed(df: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """name, width, ids and vectors: df (id, embedding) in blocks of about rows, each block one row of binary values.

    A row's block is a hash of its id; vectors of different widths lie in
    different blocks. Rows without an id or a vector, or with null in it, are
    left out. Also returns the number of blocks of a width.
    """
    sound = F.col("id").isNotNull() & F.coalesce((F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull()), F.lit(False))
    blocks = max(1, math.ceil(df.count() / rows))
    numbered = df.where(sound).select(
        F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"),
        F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("_block"), F.size("embedding").alias("_width"),
    )

    def pack(t: pa.Table) -> pa.Table:
        ids, vectors = t.column("id").to_numpy(), t.column("embedding").combine_chunks().flatten().to_numpy()
        numbers = {c: pa.array([t.column(f"_{c}")[0].as_py()], pa.int32()) for c in ("block", "width")}
        return pa.table(numbers | {"ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([vectors.astype(np.float32).tobytes()], pa.binary())})

    done = numbered.groupBy("_block", "_width").applyInArrow(pack, "block int, width int, ids binary, vectors binary")
    return done.withColumnRenamed("block", name), blocks


def dense_search(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6, skip_self: bool = True) -> DataFrame:
    """query_id, doc_id, score, rank: the k rows of corpus with the largest dot product.

    Both have (id, embedding); rows without an id or a whole vector take no part,
    and vectors of different widths do not meet. Queries and corpus are packed
    in blocks; each block of queries meets each block of the corpus in a row of
    its own, whose k best of each query go on to one ranking. Nothing passes
    the driver. Scores are rounded, ties by id.
    """
    asked, _ = packed(queries, QUERY_BLOCK, "query_block")
    held, places = packed(corpus, CORPUS_BLOCK, "place")
    # every block of queries is sent to the place of each block of the corpus
    place = F.explode(F.sequence(F.lit(0), F.lit(places - 1)))
    asked = asked.select("width", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), place.alias("place"))
    met = held.join(asked, ["place", "width"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, vectors, ids, matrix in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own, ids = np.frombuffer(own, np.int64), np.frombuffer(ids, np.int64)
                x, y = (np.frombuffer(raw, np.float32).astype(np.float64).reshape(n, -1) for raw, n in ((matrix, len(ids)), (vectors, len(own))))
                out = []
                for begin in range(0, len(ids), 256):  # bounds the scores that are held at once
                    scores = np.round(x[begin : begin + 256] @ y.T, digits)
                    for i, q in enumerate(ids[begin : begin + 256]):
                        order = np.lexsort((own, -scores[i]))[: k + 1]
                        order = order[own[order] != q][:k] if skip_self else order[:k]
                        out.append((np.full(len(order), q), own[order], scores[i][order]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "doc_id", "score"])

    found = met.select("ids", "vectors", "query_ids", "query_vectors").mapInArrow(best, "query_id long, doc_id long, score double")
    return top_k(found, k)


def cosine_search(queries: DataFrame, corpus: DataFrame, k: int, digits: int = 6, skip_self: bool = True) -> DataFrame:
    """dense_search by cosine; a vector without length has cosine 0 with all."""
    scaled = F.transform("embedding", lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("_norm")), F.lit(0.0)).cast("float"))
    unit = lambda df: df.select("id", "embedding", norm(F.col("embedding")).alias("_norm")).select("id", scaled.alias("embedding"))
    return dense_search(unit(queries), unit(corpus), k, digits, skip_self)


def hyde_search(queries: DataFrame, corpus: DataFrame, k: int, hypothesis: Transform, fallback: Transform, version: Column | None = None) -> DataFrame:
    """query_id, doc_id, score, rank: dense search with the vector of a hypothetical answer.

    hypothesis, a model, makes (id, embedding) of queries; version restricts the
    corpus. Queries for which it gives no vector go to fallback, which returns
    the same columns.
    """
    made = hypothesis(queries).where(F.size("embedding") > 0).select("id", "embedding")
    found = dense_search(made, (corpus if version is None else corpus.where(version)).select("id", "embedding"), k)
    rest = fallback(queries.join(made.select("id"), "id", "left_anti"))
    return found.select("query_id", "doc_id", "score", "rank").unionByName(rest.select("query_id", "doc_id", "score", "rank"))


def late_interaction(query: Column, document: Column) -> Column:
    """Mean over query vectors of the largest cosine with a document vector, 0 at least."""
    best = F.transform(query, lambda q: F.greatest(F.lit(0.0), F.array_max(F.transform(document, lambda d: cosine(q, d)))))
    return F.coalesce(F.try_divide(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), F.size(query)), F.lit(0.0))
