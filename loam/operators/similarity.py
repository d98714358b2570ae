"""Set similarity: the first earlier text with nearly the same words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .joins import joined_by_weight

#: Two sets match if they share at least SHARE of 20 words of the larger one.
SHARE = 19
#: Sizes of matching sets lie in one class or two neighbouring ones (a class is a little wider than 0.95).
STEP = -math.log(0.94)
#: A part with fewer words tells little; a set has SPARE parts more than could all differ, so that some may be left out.
WEAK = 3
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    """The distinct words of a text as sorted 64-bit hashes: lower case, split at ASCII white space."""
    found = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.array_sort(F.array_distinct(F.transform(found, lambda w: F.xxhash64(w))))


def overlapping(a: Column, b: Column) -> Column:
    return 20 * F.size(F.array_intersect(a, b)) >= SHARE * F.greatest(F.size(a), F.size(b))


def parts_of(level: int) -> tuple[int, int]:
    """Parts into which sets of size classes level and level + 1 are dealt, and how many of them are spare."""
    largest = int(math.exp((level + 2) * STEP)) + 1
    differ = 2 * (largest // 20)  # words in which two matching sets can differ at most
    spare = 2 + differ // 8 if differ else 0
    return differ + 1 + spare, spare


def signatures(sets: DataFrame) -> DataFrame:
    """first, signature: keys of which matching sets share at least one; no shuffle.

    A set's words are dealt into parts by hash, more parts than words in which a
    match can differ, so some part is the same in both. The key is the sum of a
    part's hashes. As many weak parts as are spare are left out; a set that has
    more keeps all, and so does its match if no other part is the same.
    """
    schema = pa.schema([("first", pa.int64()), ("signature", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out_ids, out = batch.column(0).to_numpy(), [], []
            lists = batch.column(1)
            edges, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            for i, (begin, end) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                n = end - begin
                if n < 18:  # these match equal sets only, and sets of 20 and more are out of reach
                    continue
                own = values[begin:end]
                mixed = (own ^ own >> np.uint64(31)) * MIX
                for level in {int(math.log(n) / STEP) - d for d in (0, 1)}:
                    m, spare = parts_of(level)
                    part = (mixed >> np.uint64(33)).astype(np.int64) % m
                    total = np.zeros(m, np.uint64)
                    np.add.at(total, part, mixed)
                    weak = np.bincount(part, minlength=m) < WEAK
                    kept = np.arange(m) if weak.sum() > spare else np.flatnonzero(~weak)
                    salt = np.uint64((level << 32) * 2654435761 % (1 << 64))
                    keys = (total[kept] ^ (kept.astype(np.uint64) + np.uint64(1)) * MIX) * MIX ^ salt
                    out.append(keys.view(np.int64))
                    out_ids.append(np.full(len(kept), ids[i]))
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_ids, out)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return sets.select("first", "words").mapInArrow(run, "first long, signature long")


def matched(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """first, hit: the pairs whose sets match; adaptive execution splits a set that many pairs ask for."""
    own = sets.select("first", F.col("words").alias("_own"))
    other = sets.select(F.col("first").alias("hit"), F.col("words").alias("_other"))
    return pairs.join(own, "first").join(other, "hit").where(overlapping(F.col("_own"), F.col("_other"))).select("first", "hit")


def first_matches(df: DataFrame) -> DataFrame:
    """id, hit, exact: for each row of df (id, text) the earlier row that answers it, if there is one.

    That is the first row with the same text (white space at the ends and case
    aside), else the first that shares 95 % of the words of the larger of both
    sets. Only rows with an answer are returned. ids are integers and order the
    rows; rows without one, or without text, take no part; a text without words
    has exact matches only; of rows with one id, each is answered by smaller ids.

    Rows with equal sets are one from the start. Sets meet by signatures, each
    of which asks its first set; only sets that this one doesn't answer ask the
    others that come before the best answer so far. Signatures that collide cost
    time, not rightness. Many sets that look alike without matching are compared
    in pairs.
    """
    rows = df.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select(F.col("id").cast("long").alias("id"), "text")
    same = F.lower(F.regexp_replace("text", r"^\s+|\s+$", ""))
    keyed = rows.select("id", F.sha2(same, 256).alias("key"), words(F.col("text")).alias("words"))
    keyed = stored(keyed.withColumn("set", F.sha2(F.array_join(F.transform("words", lambda w: w.cast("string")), ","), 256)), "word-sets")
    exact = keyed.groupBy("key").agg(F.min("id").alias("same"), F.count("*").alias("n"))
    exact = stored(exact, "same-texts")
    sets = keyed.where(F.size("words") > 0).groupBy("set").agg(F.min("id").alias("first"), F.first("words").alias("words"), F.count("*").alias("n"))
    sets = stored(sets, "sets")
    members = stored(signatures(sets), "signatures")
    buckets = stored(members.groupBy("signature").agg(F.min("first").alias("head"), F.count("*").alias("n")).where("n > 1"), "buckets")
    headed = stored(joined_by_weight(members, buckets, ["signature"], "n").drop("n"), "headed")
    asked = headed.where("first > head").select("first", F.col("head").alias("hit")).distinct()
    found = stored(matched(asked, sets), "matches").groupBy("first").agg(F.min("hit").alias("hit"))
    # a bucket is open to a set as long as members between its head and the best answer have not been asked
    best = headed.join(found, "first", "left").withColumn("best", F.coalesce("hit", "first"))
    open_ = best.where("head < best").select("first", "signature", "head", "best")
    others = headed.where("first > head").select("signature", F.col("first").alias("hit"))
    more = open_.join(others, "signature").where("hit < best").select("first", "hit").distinct()
    every = found.unionByName(matched(more, sets)).groupBy("first").agg(F.min("hit").alias("hit"))
    reach = sets.join(every, "first", "left").select("set", "n", F.least(F.coalesce("hit", "first"), "first").alias("near"))
    reach = stored(reach.unionByName(keyed.where(F.size("words") == 0).groupBy("set").agg(F.count("*").alias("n")).withColumn("near", F.lit(None).cast("long"))), "reach")
    told = joined_by_weight(joined_by_weight(keyed.select("id", "key", "set"), exact, ["key"], "n").drop("n"), reach, ["set"], "n")
    is_exact = F.col("same") < F.col("id")
    hit = F.when(is_exact, F.col("same")).when(F.col("near") < F.col("id"), F.col("near"))
    return told.select("id", hit.alias("hit"), is_exact.alias("exact")).where("hit is not null")
