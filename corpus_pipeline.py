"""Corpus preparation: documents through five stages, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of docs. run() writes each stage's rows to the shared
folder as Parquet and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import fm, minhash, packing, queries, rlz, secrets
from loam.llm.common import discard, documents, labels, quoted, stored
from loam.session import scratch

#: No SQL states a factorisation machine's or a compressor's decisions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the factorisation machine accepts (score of at least 0.7), unchanged.

    A null text is scored as an empty one. Each row is judged by its own text,
    whatever its doc_id.
    """
    machine = fm.train(docs, labels(spark, sf_dir))
    return fm.accepted(docs, machine)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, similarity 0.8), and every row that copies nothing.

    The one that stays has the least doc_id (rows without one come last). Rows
    are told apart by doc_id and text, so neither a repeated doc_id nor a
    missing one takes a row away. Of rows equal in both, the one whose other
    columns come first as JSON stays. Rows without words are no copies: all stay.
    """
    judged = minhash.judged(docs, k=5, percent=80)
    gone = judged.where(~F.col("first")).select("row").distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    left = docs.where(worded).join(gone, minhash.row_key() == gone["row"], "left_anti")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return left.distinct().union(docs.where(~worded))
    held = F.struct(*[F.col(quoted(c)) for c in rest])
    one = left.groupBy("doc_id", "text").agg(F.min_by(held, F.to_json(held)).alias("rest"))
    new = {c: F.col("rest").getField(c) for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return one.select(*[new[c].alias(c) for c in docs.columns]).union(docs.where(~worded))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the words under windows of 35 words that stand elsewhere too.

    A text that loses words becomes the rest joined by one space; n_chars follows.
    """
    return rlz.replaced(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its secrets replaced by a mark; n_chars follows."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all texts in sequences of 2048 tokens; a null or empty text is its end mark."""
    return packing.pack(docs, queries.word_bpe())


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scan", secret_spans),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch() as tables:  # what a stage stores on its way goes once its rows are written
            made = tables.keep(stored(stage(spark, docs, sf_dir), name))
        if name != STAGES[0][0]:
            discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
