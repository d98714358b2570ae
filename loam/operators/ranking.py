"""Fusion, thresholds, knees and reordering of ranked lists keyed by query_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores from which a hit is strong, or borderline.
STRONG, BORDERLINE = 0.32, 0.25


def per_query(by: str = "query_id"):
    return Window.partitionBy(by)


def ranked(df: DataFrame, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(per_query().orderBy(F.desc("score"), "doc_id")))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 60, sentinel: bool = True) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: query_id, doc_id, score (sparse first), rrf_score.

    With sentinel, a hit in one list also gets the term of a rank behind the
    other list's end, so that ids in both lists have four terms; without, the
    textbook form.
    """
    sizes = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    d = dense.select("query_id", "doc_id", F.col("score").alias("d_score"), F.col("rank").alias("d_rank"))
    s = sparse.select("query_id", "doc_id", F.col("score").alias("s_score"), F.col("rank").alias("s_rank"))
    both = d.join(s, ["query_id", "doc_id"], "full").join(sizes(dense, "n_d"), "query_id", "left").join(sizes(sparse, "n_s"), "query_id", "left")
    term = lambda rank: F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))
    extra = lambda rank, n: F.when(F.col(rank).isNotNull(), 1.0 / (2 * k + F.greatest(F.coalesce(F.col(n), F.lit(0)), F.lit(1)))).otherwise(0.0)
    rrf = term("d_rank") + term("s_rank")
    if sentinel:
        rrf = rrf + extra("d_rank", "n_s") + extra("s_rank", "n_d")
    return both.select("query_id", "doc_id", F.coalesce("s_score", "d_score").alias("score"), rrf.alias("rrf_score"))


def threshold(df: DataFrame, strong: float = STRONG, borderline: float = BORDERLINE) -> DataFrame:
    """Strong hits and some borderline ones: two beside two strong, one beside one, else three; adds level."""
    klass = F.when(F.col("score") >= strong, "strong").when(F.col("score") >= borderline, "borderline")
    held = df.withColumn("class", klass).where(F.col("class").isNotNull())
    n = F.count_if(F.col("class") == "strong").over(per_query())
    place = F.row_number().over(Window.partitionBy("query_id", "class").orderBy(F.desc("score"), "doc_id"))
    held = held.withColumn("n_strong", n).withColumn("place", place)
    allowed = F.when(F.col("n_strong") >= 2, 2).when(F.col("n_strong") == 1, 1).otherwise(3)
    level = F.when(F.col("n_strong") >= 1, "strong").otherwise("borderline")
    return held.where((F.col("class") == "strong") | (F.col("place") <= allowed)).withColumn("level", level).drop("class", "n_strong", "place")


def knee(df: DataFrame, sensitivity: float = 0.5) -> DataFrame:
    """Hits up to the point farthest from the chord of the normalised score curve; two at least.

    Up to two hits stay as they are; a flat curve keeps max(2, n * sensitivity).
    """
    w = per_query()
    r = ranked(df, "r")
    x = (F.col("r") - 1) / (F.col("n") - 1)
    y = (F.col("score") - F.col("low")) / (F.col("high") - F.col("low"))
    r = r.withColumn("n", F.count("*").over(w)).withColumn("low", F.min("score").over(w)).withColumn("high", F.max("score").over(w))
    r = r.withColumn("away", F.when((F.col("n") > 2) & (F.col("high") > F.col("low")), F.round(F.abs(x + y - 1), 9)))
    r = r.withColumn("knee", F.greatest(F.max_by("r", F.struct("away", -F.col("r"))).over(w), F.lit(2)))
    most = F.when(F.col("n") <= 2, F.col("n")).when(F.col("high") == F.col("low"), F.greatest(F.lit(2), F.floor(F.col("n") * sensitivity))).otherwise(F.col("knee"))
    return r.where(F.col("r") <= most).drop("r", "n", "low", "high", "away", "knee")


def largest_drop(df: DataFrame) -> DataFrame:
    """query_id and knee: hits before the first largest fall of the score; all, if fewer than three or no fall."""
    r = ranked(df, "r").withColumn("fall", F.lag("score").over(per_query().orderBy("r")) - F.col("score"))
    out = r.groupBy("query_id").agg(F.count("*").alias("n"), F.max("fall").alias("fall"), F.max_by(F.col("r") - 1, F.struct("fall", -F.col("r"))).alias("at"))
    return out.select("query_id", F.when((F.col("n") < 3) | (F.col("fall") <= 0), F.col("n")).otherwise(F.col("at")).cast("long").alias("knee"))


def interleaved_order(rank: Column, n: Column) -> Column:
    """Even places (from 0) in order, then odd ones backwards: the best stand at both ends."""
    i = rank - 1
    return F.when(i % 2 == 0, F.floor(i / 2)).otherwise(n - 1 - F.floor(i / 2))


def edges_order(rank: Column, n: Column) -> Column:
    """The best first, the second best last, the others by score between them."""
    return F.when(rank == 1, 0).when(rank == 2, n - 1).otherwise(rank - 2)


def progressive(df: DataFrame, stages: tuple[int, ...] = (5, 10, 20), strong: float = STRONG, least: int = 2) -> DataFrame:
    """Hits of the first stage whose top-k holds least strong ones; of the last if none does."""
    r = ranked(df, "r").withColumn("stage", F.explode(F.array(*map(F.lit, stages)))).where("r <= stage")
    good = r.groupBy("query_id", "stage").agg(F.count_if(F.col("score") >= strong).alias("n"))
    chosen = good.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("stage"))), F.max("stage")).alias("stage"))
    return r.join(chosen, ["query_id", "stage"], "left_semi").drop("r")
