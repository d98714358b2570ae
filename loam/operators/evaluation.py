"""Retrieval metrics, confidence, grounding and gates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def ideal(n: Column, k: int) -> Column:
    """Ideal discounted gain of n relevant items in k places."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(n, F.lit(k)).cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))


def query_metrics(retrieved: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per query: rr, recall@k, ndcg@k, precision@k from (query_id, doc_id, rank) and (query_id, doc_id).

    A query without relevant items has recall and ndcg 1 and no rr; without
    retrieved items precision 0. One aggregation over one join.
    """
    marked = retrieved.join(relevant.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(True)), ["query_id", "doc_id"], "left")
    sizes = relevant.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n"))
    return marked_metrics(marked.withColumn("hit", F.coalesce("hit", F.lit(False))), sizes, ks)


def class_hits(retrieved: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """retrieved with hit: whether the row has the label of its query. Labels are looked up, relevant pairs never listed."""
    wanted = queries.select(F.col("id").alias("query_id"), F.col("label").alias("_wanted"))
    held = corpus.select(F.col("id").alias("doc_id"), F.col("label").alias("_label"))
    met = retrieved.join(held, "doc_id", "left").join(wanted, "query_id", "left")
    return met.withColumn("hit", F.coalesce(F.col("_wanted") == F.col("_label"), F.lit(False))).drop("_wanted", "_label")


def class_metrics(retrieved: DataFrame, queries: DataFrame, corpus: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """query_metrics where the rows of corpus (id, label) with a query's label are relevant, but for the query itself.

    How many there are comes from one count a label, so a common label costs no more than a rare one.
    """
    counts = corpus.groupBy("label").agg(F.count("*").alias("_same"))
    own = corpus.select("id", F.lit(1).alias("_own"))
    sizes = queries.join(counts, "label", "left").join(own, "id", "left")
    sizes = sizes.select(F.col("id").alias("query_id"), (F.coalesce("_same", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("n"))
    return marked_metrics(class_hits(retrieved, queries, corpus), sizes, ks)


def marked_metrics(marked: DataFrame, sizes: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Metrics of each query from retrieved rows (query_id, rank, hit) and its number n of relevant items."""
    hit = F.col("hit")
    aggs = [F.min(F.when(hit, F.col("rank"))).alias("first")]
    for k in ks:
        near = hit & (F.col("rank") <= k)
        aggs += [F.count_if(near).alias(f"hits_{k}"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}")]
    found = marked.groupBy("query_id").agg(*aggs)
    both = found.join(sizes, "query_id", "full").fillna(0, ["n", *[f"hits_{k}" for k in ks]]).fillna(0.0, [f"dcg_{k}" for k in ks])
    none = F.col("n") == 0
    out = [F.when(~none, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("rr")]
    for k in ks:
        out += [
            F.when(none, 1.0).otherwise(F.col(f"hits_{k}") / F.col("n")).alias(f"recall_{k}"),
            F.when(none, 1.0).otherwise(F.col(f"dcg_{k}") / ideal(F.col("n"), k)).alias(f"ndcg_{k}"),
            (F.col(f"hits_{k}") / k).alias(f"precision_{k}"),
        ]
    return both.select("query_id", *out)


def mean_metrics(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = [c for c in per_query.columns if c not in ("query_id", *(by or []))]
    aggs = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("mrr" if c == "rr" else c) for c in names]
    return (per_query.groupBy(*by) if by else per_query.groupBy()).agg(*aggs, F.count("*").alias("num_queries"))


def retrieval_confidence(df: DataFrame) -> DataFrame:
    """query_id, confidence, action from scores: 0.4 mean + 0.3 coverage + 0.2 count + 0.1 steadiness."""
    s = F.col("score")
    agg = df.groupBy("query_id").agg(F.avg(s).alias("mean"), F.var_pop(s).alias("var"), F.count("*").alias("n"), F.count_if(s > 0.7).alias("high"), F.count_if((s > 0.4) & (s <= 0.7)).alias("mid"))
    value = F.col("mean") * 0.4 + (F.col("high") + F.col("mid") * 0.5) / F.col("n") * 0.3 + F.least(F.lit(1.0), F.col("n") / 5) * 0.2 + 1 / (1 + F.col("var")) * 0.1
    value = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 6)
    return agg.select("query_id", value.alias("confidence")).withColumn("action", action(F.col("confidence"), 0.7, 0.4, 0.2))


def action(value: Column, use: float, rewrite: float, expand: float) -> Column:
    return F.when(value >= use, "USE").when(value >= rewrite, "REWRITE").when(value >= expand, "EXPAND").otherwise("FALLBACK")


def domain_confidence(mean: Column, coverage: Column, n: Column, recency: Column) -> Column:
    return F.least(mean / 0.8, F.lit(1.0)) * 0.4 + F.least(coverage, F.lit(1.0)) * 0.3 + F.least(n / 5, F.lit(1.0)) * 0.2 + recency * 0.1


def signal_confidence(context: Column, answer: Column, nli: Column, doubts: Column) -> Column:
    """Confidence from lengths, a grounding score (null: none) and the number of doubtful phrases."""
    score = F.lit(0.7) - F.when(context < 20, 0.4).otherwise(0.0) - F.when((context > 0) & (context < answer * 0.5), 0.2).otherwise(0.0)
    score = score - F.when(doubts > 0, 0.2).otherwise(0.0) - F.when(answer < 20, 0.15).otherwise(0.0)
    score = F.coalesce(score * 0.6 + nli * 0.4, score)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


#: A word of a text in lower case, and words that ask rather than tell.
WORD, KEYWORD = re.compile(r"\w+"), re.compile(r"[a-z0-9]+")
STOP = frozenset(T.METRIC_STOP)


def keywords_of(text: str) -> set[str]:
    return {w for w in KEYWORD.findall(text) if len(w) > 1 and w not in STOP}


def claim_counts(claims: Column, context: Column, keywords: bool = False) -> Column:
    """struct(n, sizes, hits): words of a context, words of each claim, and how many of them the context has.

    Words are told apart, in lower case; with keywords only those of ASCII
    letters and digits that are no stop words. A context is read once, so a long
    text of many claims costs its length.
    """
    find = keywords_of if keywords else lambda text: set(WORD.findall(text))

    @F.pandas_udf("struct<n:int,sizes:array<int>,hits:array<int>>")
    def count(claims: pd.Series, contexts: pd.Series) -> pd.DataFrame:
        out = []
        for own, context in zip(claims, contexts, strict=True):
            known = find((context or "").lower())
            sets = [find(x.lower()) for x in (own if own is not None else [])]
            out.append((len(known), [len(x) for x in sets], [len(x & known) for x in sets]))
        return pd.DataFrame(out, columns=["n", "sizes", "hits"])

    return count(claims, context)


def supports(n: Column, size: Column, hits: Column) -> Column:
    """Half cosine, half containment of a claim of size words, hits of them in a context of n; 0 where either has none."""
    both = hits / F.sqrt(size.cast("double") * n) * 0.5 + hits / size * 0.5
    return F.when((size == 0) | (n == 0), 0.0).otherwise(both)


def grounded_claims(df: DataFrame, threshold: float) -> DataFrame:
    """id, at, claim, support, supported: each claim of answer against its context, by half cosine and half containment."""
    read = df.select("id", T.claims(F.col("answer")).alias("claims"), "context").withColumn("x", claim_counts(F.col("claims"), F.col("context")))
    claims = read.select("id", F.col("x.n").alias("n"), F.posexplode(F.arrays_zip("claims", F.col("x.sizes").alias("size"), F.col("x.hits").alias("hits"))).alias("at", "y"))
    scored = claims.select("id", "at", F.col("y.claims").alias("claim"), supports(F.col("n"), F.col("y.size"), F.col("y.hits")).alias("support"))
    return scored.withColumn("supported", F.col("support") >= threshold)


def claim_report(df: DataFrame, threshold: float = 0.25) -> DataFrame:
    """id, rate, supported and unsupported claims in order, total, for each row of df (id, answer, context).

    An answer without claims has rate 0 and no claims; against a blank context
    no claim is supported.
    """
    read = df.select("id", F.coalesce(T.claims(F.col("answer")), F.array().cast("array<string>")).alias("claims"), "context").withColumn("x", claim_counts(F.col("claims"), F.col("context")))
    held = F.transform("claims", lambda claim, i: F.struct(claim.alias("claim"), (supports(F.col("x.n"), F.col("x.sizes")[i], F.col("x.hits")[i]) >= threshold).alias("yes")))
    read = read.select("id", held.alias("c"))
    which = lambda yes: F.transform(F.filter("c", lambda x: x["yes"] == yes), lambda x: x["claim"])
    rows = read.select("id", which(True).alias("supported"), which(False).alias("unsupported"), F.size("c").alias("total"))
    return rows.select("id", F.round(F.coalesce(F.try_divide(F.size("supported"), "total"), F.lit(0.0)), 3).alias("rate"), "supported", "unsupported", "total")


def first_sentences(claims: list[str], context: str, least: float) -> list[str | None]:
    """For each claim the first sentence of context that supports it; sentences are asked through an index of their words."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", context)]
    sets = [set(WORD.findall(s.lower())) for s in sentences]
    sizes = np.array([len(x) for x in sets])
    places: dict[str, list[int]] = {}
    for i, words in enumerate(sets):
        for w in words:
            places.setdefault(w, []).append(i)
    out: list[str | None] = []
    for claim in claims:
        own = set(WORD.findall(claim.lower()))
        hits = np.bincount([i for w in own for i in places.get(w, ())], minlength=len(sets))
        at = np.flatnonzero(hits)
        share = hits[at] / np.sqrt(float(len(own)) * sizes[at]) * 0.5 + hits[at] / max(1, len(own)) * 0.5
        good = at[share >= least]
        out.append(sentences[good[0]].strip() if len(good) else None)
    return out


def hallucinations(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """id, rate, hallucinated claims, supported, total and evidence of each row of df (id, answer, context).

    evidence has, for each supported claim in order, the first sentence of the
    context that supports it alone, or "context" where only the whole does. An
    answer without claims has rate 0.
    """
    report = claim_report(df, threshold).withColumnsRenamed({"id": "_id", "supported": "_yes", "unsupported": "hallucinated", "rate": "_rate"})
    rows = df.select("id", "context").join(report, F.col("id").eqNullSafe(F.col("_id")))

    @F.pandas_udf("array<string>")
    def evidence(claims: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([[x or "context" for x in first_sentences(list(own), context or "", threshold)] for own, context in zip(claims, contexts, strict=True)])

    rate = F.round(F.coalesce(F.try_divide(F.size("hallucinated"), "total"), F.lit(0.0)), 3)
    return rows.select("id", rate.alias("rate"), "hallucinated", F.col("_yes").alias("supported"), "total", evidence("_yes", "context").alias("evidence"))


def keywords(text: Column) -> Column:
    """keywords_of as a column."""
    return F.filter(F.array_distinct(T.matches(F.lower(text), "[a-z0-9]+")), lambda w: (F.length(w) > 1) & ~w.isin(T.METRIC_STOP))


def lexical_metrics(df: DataFrame) -> DataFrame:
    """id, faithfulness, answer_relevance, context_relevance, overall of each row of df (id, question, answer, contexts).

    faithfulness: share of an answer's sentences of more than ten characters of
    which the contexts hold 30 % of the keywords (1 without such a sentence);
    answer_relevance: share of the question's keywords in the answer;
    context_relevance: share of contexts that hold 30 % of them (both one half
    without keywords). 0 where a side is missing.
    """
    sentences = F.filter(F.transform(F.split("answer", r"\."), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > 10)
    rows = df.select("id", "question", "answer", "contexts", sentences.alias("s"), F.array_join("contexts", " ").alias("joined"), keywords(F.col("question")).alias("q"))
    rows = rows.withColumn("x", claim_counts(F.col("s"), F.col("joined"), keywords=True)).withColumn("a", keywords(F.col("answer")))
    good = F.size(F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (F.col("x.sizes")[i] > 0) & (F.col("x.hits")[i] / F.col("x.sizes")[i] >= 0.3)))
    missing = lambda x: F.coalesce(F.length(x), F.lit(0)) == 0
    faithful = F.when(missing("answer") | missing("joined"), 0.0).when(F.size("s") == 0, 1.0).otherwise(good / F.size("s"))
    share = lambda words: T.overlap(F.col("q"), words) / F.size("q")
    answered = F.when(missing("question") | missing("answer"), 0.0).when(F.size("q") == 0, 0.5).otherwise(share(F.col("a")))
    near = F.size(F.filter("contexts", lambda x: share(keywords(x)) >= 0.3))
    relevant = F.when(missing("question") | (F.coalesce(F.size("contexts"), F.lit(0)) == 0), 0.0).when(F.size("q") == 0, 0.5).otherwise(near / F.size("contexts"))
    made = rows.select("id", faithful.alias("f"), answered.alias("a"), relevant.alias("c"))
    names = {"f": "faithfulness", "a": "answer_relevance", "c": "context_relevance"}
    return made.select("id", *[F.round(k, 6).alias(v) for k, v in names.items()], F.round((F.col("f") + F.col("a") + F.col("c")) / 3, 6).alias("overall"))


def lite_metrics(df: DataFrame) -> DataFrame:
    """id, faithfulness, relevancy, precision (four digits) of each row of df (id, question, answer, contexts).

    faithfulness: share of an answer's claims that the contexts support by 0.3
    (1 without claims); relevancy: share of the question's words in the answer
    (one half without words); precision: share of contexts of whose words the
    answer holds 15 %. 0 where a side is missing or blank.
    """
    rows = df.select("id", "question", "answer", "contexts", F.coalesce(T.claims(F.col("answer")), F.array().cast("array<string>")).alias("claims"), F.array_join("contexts", " ").alias("joined"))
    rows = rows.withColumn("x", claim_counts(F.col("claims"), F.col("joined"))).withColumn("a", T.word_set(F.col("answer"))).withColumn("q", T.word_set(F.col("question")))
    good = F.size(F.filter(F.sequence(F.lit(0), F.size("claims") - 1), lambda i: supports(F.col("x.n"), F.col("x.sizes")[i], F.col("x.hits")[i]) >= 0.3))
    blank = lambda x: F.coalesce(~F.col(x).rlike(r"\S"), F.lit(True))
    missing = lambda x: F.coalesce(F.length(x), F.lit(0)) == 0
    faithful = F.when(blank("answer") | blank("joined"), 0.0).when(F.size("claims") == 0, 1.0).otherwise(good / F.size("claims"))
    relevancy = F.when(missing("answer") | missing("question"), 0.0).when(F.size("q") == 0, 0.5).otherwise(T.overlap(F.col("q"), F.col("a")) / F.size("q"))
    used = F.size(F.filter(F.transform("contexts", T.word_set), lambda w: (F.size(w) > 0) & (T.overlap(F.col("a"), w) / F.size(w) >= 0.15)))
    precision = F.when(missing("answer") | (F.size("a") == 0) | (F.coalesce(F.size("contexts"), F.lit(0)) == 0), 0.0).otherwise(used / F.size("contexts"))
    return rows.select("id", F.round(faithful, 4).alias("faithfulness"), F.round(relevancy, 4).alias("relevancy"), F.round(precision, 4).alias("precision"))


def grounding(df: DataFrame, threshold: float = 0.25) -> DataFrame:
    """id, total, supported, score (three digits): share of an answer's claims that its context supports."""
    return grounded_claims(df, threshold).groupBy("id").agg(F.count("*").alias("total"), F.count_if("supported").alias("supported")).withColumn("score", F.round(F.col("supported") / F.col("total"), 3))


def novel_words(df: DataFrame) -> DataFrame:
    """id and rate: share of an answer's words, repeated ones counted, that its context lacks; 0 without words.

    Words of both sides meet on (id, word), so a long pair costs its length.
    """
    own = df.select("id", F.explode_outer(T.words(F.col("answer"))).alias("word")).groupBy("id", "word").agg(F.count("word").alias("n"))
    known = df.select("id", F.explode(T.word_set(F.col("context"))).alias("word")).withColumn("known", F.lit(True))
    met = own.join(known, ["id", "word"], "left")
    share = F.try_divide(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)), F.sum("n"))
    return met.groupBy("id").agg(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("rate"))


def calibrated(df: DataFrame) -> DataFrame:
    """threshold, f1: the score cutoff of best F1 over (score, label); observed scores beat midpoints, then the lower.

    Candidates are the distinct scores and the midpoints between neighbours.
    True and false positives are running sums, first over ranges of scores, of
    which there is a fixed number, and then inside each range.
    """
    from pyspark.sql import Window

    from .analytics import ranges_of

    one = df.withColumn("_all", F.lit(1))
    counts = one.groupBy("_all", "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    counts = counts.join(ranges_of(one, ["_all"], "score").select("score", "range"), "score")
    coarse = counts.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.max("score").alias("top"))
    above = Window.orderBy(F.desc("range"))
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("range", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("tp0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("fp0"), F.lead("top").over(above).alias("below"))
    total = counts.agg(F.sum("pos").alias("all_pos"))
    down = Window.partitionBy("range").orderBy(F.desc("score"))
    steps = counts.select("range", "score", F.sum("pos").over(down).alias("tp1"), F.sum("neg").over(down).alias("fp1"), F.lead("score").over(down).alias("near")).join(F.broadcast(coarse), "range")
    steps = steps.select("score", (F.col("tp0") + F.col("tp1")).alias("tp"), (F.col("fp0") + F.col("fp1")).alias("fp"), F.coalesce("near", "below").alias("next"))
    steps = steps.crossJoin(F.broadcast(total)).withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")), F.lit(0.0)))
    both = steps.select("score", "f1", F.lit(1).alias("seen")).union(steps.where("next is not null").select((F.col("score") + F.col("next")) / 2, "f1", F.lit(0)))
    return both.agg(F.max_by("score", F.struct("f1", "seen", -F.col("score"))).alias("threshold"), F.max("f1").alias("f1"))


def model_score(pairs: DataFrame, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """precision, recall, f1: means over (hypothesis, reference) of a model's struct<precision, recall, f1>; zeros without a model."""
    names = ("precision", "recall", "f1")
    if score is None:
        return pairs.agg(F.count("*").alias("n")).select(*[F.lit(0.0).alias(x) for x in names])
    made = pairs.select(score(F.col("hypothesis"), F.col("reference")).alias("x"))
    return made.agg(*[F.avg(F.col("x")[x]).alias(x) for x in names])


def gate(metrics: DataFrame, thresholds: DataFrame, baseline: DataFrame | None = None, tolerance: float = 0.02, needs_baseline: bool = False) -> DataFrame:
    """metric, value, passed, delta, regressed, status, overall: metrics (metric, value) against thresholds and a baseline.

    thresholds has metric, comparison (>=, >, <=, <, ==), threshold and severity
    (fail or warn); a metric without one passes, a threshold without a metric
    does nothing. delta is the value less the baseline's. A metric whose
    threshold is severe warns where it lost more than tolerance (0: not asked).
    status is FAIL, WARN or PASS of a metric, overall the worst of all, a warning
    too where a baseline is needed and not given. Tables of a few rows each.
    """
    v, limit = F.col("value"), F.col("threshold")
    compared = {">=": v >= limit, ">": v > limit, "<=": v <= limit, "<": v < limit, "==": v == limit}
    holds = F.lit(None).cast("boolean")
    for sign, test in compared.items():
        holds = F.when(F.col("comparison") == sign, test).otherwise(holds)
    rows = metrics.join(thresholds, "metric", "left")
    rows = rows.join(baseline.select("metric", F.col("value").alias("was")), "metric", "left") if baseline is not None else rows.withColumn("was", F.lit(None).cast("double"))
    rows = rows.withColumn("passed", F.coalesce(holds, F.lit(True))).withColumn("delta", v - F.col("was"))
    rows = rows.withColumn("regressed", F.coalesce((F.col("severity") == "fail") & (F.col("delta") < -tolerance), F.lit(False)) & F.lit(tolerance > 0))
    worst = F.when(~F.col("passed") & (F.col("severity") == "fail"), 2).when(~F.col("passed") | F.col("regressed"), 1).otherwise(0)
    rows = rows.groupBy("metric").agg(F.first("value").alias("value"), F.min("passed").alias("passed"), F.first("delta").alias("delta"), F.max("regressed").alias("regressed"), F.max(worst).alias("worst"))
    named = lambda x: F.element_at(F.array(*map(F.lit, ("PASS", "WARN", "FAIL"))), x + 1)
    least = F.lit(1 if needs_baseline and baseline is None else 0)
    every = rows.agg(F.greatest(F.max("worst"), least).alias("all"))  # one row
    return rows.crossJoin(F.broadcast(every)).select("metric", "value", "passed", "delta", "regressed", named(F.col("worst")).alias("status"), named(F.col("all")).alias("overall"))


#: Words of both sides whose n-grams are counted at once inside a Python worker.
GRAM_WORDS = 500_000


def gram_counts(group: np.ndarray, sides: tuple[pa.Array, pa.Array], orders: int) -> list[tuple[int, int, int]]:
    """(n, hit, total) of pairs of word lists: clipped hits and n-grams of the first side; under n = 0 the words of either side.

    Pairs of one group, which are neighbours, are counted as one. A group that
    has n-grams on its second side alone has a total of 1. Only places whose
    shorter gram is on both sides are looked at for the longer one.
    """
    lengths = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in sides]
    groups = int(group[-1]) + 1 if len(group) else 0
    out = [(0, *(int(x.sum()) for x in lengths))]
    words = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode()
    word, kinds = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
    length = np.concatenate(lengths)
    ends = np.repeat(np.cumsum(length), length)
    second = np.arange(len(word)) >= lengths[0].sum()
    place, gram = np.arange(len(word)), np.repeat(np.concatenate([group, group]), length)
    for n in range(1, orders + 1):
        grams = [np.bincount(group, np.maximum(x - n + 1, 0), groups).astype(np.int64) for x in lengths]
        if any(x.any() for x in grams):
            held = place + n <= ends[place]
            place, gram = place[held], gram[held]
            # a gram is the shorter one, or its group, and a word more
            made, gram = np.unique(gram * kinds + word[place + n - 1], return_inverse=True)
            counts = [np.bincount(gram[second[place] == x], minlength=len(made)) for x in (False, True)]
            both = np.minimum(*counts)
            out.append((n, int(both.sum()), int(np.maximum(grams[0], 1)[(grams[0] > 0) | (grams[1] > 0)].sum())))
            kept = both[gram] > 0
            place, gram = place[kept], gram[kept]
    return out


def bleu_counts(pairs: DataFrame, orders: int = 4) -> DataFrame:
    """n, hit, total of parts of pairs (id, h, r: words of a hypothesis and its reference), to be summed by n; see gram_counts.

    Pairs of one id are one. n-grams never leave the task of their pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            ids = rows.column("id").to_numpy()
            group = np.cumsum(np.r_[0, ids[1:] != ids[:-1]])[: len(ids)]
            sides = tuple(pa.concat_arrays(rows.column(x).chunks) for x in "hr")
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*gram_counts(group, sides, orders), strict=True)], names=["n", "hit", "total"])

        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            ids = rows.column("id").to_numpy()
            # parts of whole ids; the last id may go on in the next batch
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            sizes = sum(pc.fill_null(pc.list_value_length(rows.column(x)), 0).to_numpy().astype(np.int64) for x in "hr")
            part = (np.cumsum(sizes) - sizes)[first] // GRAM_WORDS
            edges = np.r_[first[np.r_[True, part[1:] != part[:-1]]], first[-1]]
            for begin, end in zip(edges[:-1], edges[1:], strict=True):
                if end > begin:
                    yield counted(rows.slice(begin, end - begin))
            held = rows.slice(first[-1])
        if held is not None:
            yield counted(held)

    return pairs.select(F.col("id").cast("long").alias("id"), "h", "r").sortWithinPartitions("id").mapInArrow(run, "n long, hit long, total long")
