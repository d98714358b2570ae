"""Shortening contexts to what a query, or a budget, needs."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

WORD = re.compile(r"\w+")

#: Words that carry no content.
EMPTY_WORDS = frozenset(
    [
        "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
        "will", "would", "could", "should", "may", "might", "can", "shall", "to", "of", "in", "for", "on", "with", "at",
        "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "out", "off",
        "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
        "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
        "than", "too", "very", "just", "because", "but", "and", "or", "if", "while", "about", "up", "it", "its", "this",
        "that", "these", "those", "i", "me", "my", "we", "our", "you", "your", "he", "him", "his", "she", "her", "they",
        "them", "their", "which", "what", "who", "whom", "whose",
    ]
)


def scored_sentences(pairs: DataFrame, key: list[str], least: int = 3) -> DataFrame:
    """key, n, whole, and x: the sentences of each pair's text in order, as (at, hits, sentence).

    pairs has key, text and q, the distinct words of a query, of which there are
    n. hits counts those that a sentence has. A text of at most least sentences,
    or a query without words, gives one whole sentence; a null text reads as
    empty. Each sentence is read once; a group is the sentences of one text.
    """
    parts = pairs.select(*key, F.coalesce("text", F.lit("")).alias("text"), "q").select(*key, "text", "q", T.sentences(F.col("text")).alias("s"))
    whole = (F.size("s") <= least) | (F.size("q") == 0)
    parts = parts.select(*key, "q", whole.alias("whole"), F.when(whole, F.array("text")).otherwise(F.col("s")).alias("s"))
    rows = parts.select(*key, "q", "whole", F.posexplode("s").alias("at", "sentence"))
    rows = rows.select(*key, "whole", F.size("q").alias("n"), F.struct("at", T.overlap(F.col("q"), T.word_set(F.col("sentence"))).alias("hits"), "sentence").alias("x"))
    return rows.groupBy(*key).agg(F.first("n").alias("n"), F.first("whole").alias("whole"), F.array_sort(F.collect_list("x")).alias("x"))


def joined(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda z: z["sentence"]), " ")


def relevant_sentences(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key and short: the sentences with at least half the mean share of the query's words (0.05 at least).

    Where none has, the first three; short texts whole. Shares are compared as
    whole numbers: hits * 20 >= n and 2 * hits * sentences >= all hits.
    """
    rows = scored_sentences(pairs, key)
    total = F.aggregate("x", F.lit(0), lambda a, z: a + z["hits"])
    rows = rows.select(*key, "n", "whole", "x", total.alias("total"), F.size("x").alias("count"))
    kept = F.filter("x", lambda z: (z["hits"] * 20 >= F.col("n")) & (2 * z["hits"] * F.col("count") >= F.col("total")))
    rows = rows.select(*key, "whole", "x", kept.alias("kept"))
    short = F.when(F.col("whole"), F.col("x")[0]["sentence"]).when(F.size("kept") > 0, joined(F.col("kept"))).otherwise(joined(F.slice("x", 1, 3)))
    return rows.select(*key, short.alias("short"))


def top_sentences(pairs: DataFrame, key: list[str], most: int = 3) -> DataFrame:
    """key and short: the most sentences with the most words of the query, best first, ties in order."""
    rows = scored_sentences(pairs, key, most)
    best = F.slice(F.array_sort(F.transform("x", lambda z: F.struct((-z["hits"]).alias("hits"), z["at"].alias("at"), z["sentence"].alias("sentence")))), 1, most)
    return rows.select(*key, F.when(F.col("whole"), F.trim(F.col("x")[0]["sentence"])).otherwise(joined(best)).alias("short"))


def decomposed(chunks: DataFrame, least: float = 0.2, long: int = 3000) -> DataFrame:
    """doc_id, score, text of chunks with a score of at least least, one of each beginning, long ones shortened.

    Two chunks are alike if their trimmed texts have the same first 120
    characters without case: the first by doc_id stays. Of a text of more than
    long characters, the first ten sentences of more than 15 characters stay,
    or all of it if there is none. Chunks without text are left out.
    """
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    signed = chunks.where(F.col("score") >= least).withColumn("_key", F.lower(F.substring(trimmed, 1, 120))).where("_key <> ''")
    first = signed.groupBy("_key").agg(F.min_by(F.struct("doc_id", "score", "text"), "doc_id").alias("x")).select("x.*")
    kept = F.filter(T.sentences(F.col("text")), lambda s: F.length(s) > 15)
    short = T.once(kept, lambda x: F.when(F.size(x) > 0, F.array_join(F.slice(x, 1, 10), " ")).otherwise(F.col("text")))
    return first.select("doc_id", "score", F.when(F.length("text") > long, short).otherwise(F.col("text")).alias("text"))


def density(sentence: Column) -> Column:
    """Distinct content words by half, 0.15 for a number, 0.35 for all; less if very short or long; 0 without words."""
    words = T.words(sentence)
    n = F.size(words)
    content = F.size(F.array_except(words, F.array(*[F.lit(w) for w in sorted(EMPTY_WORDS)])))
    value = 0.5 * content / n + F.when(sentence.rlike(r"\p{Nd}"), 0.15).otherwise(0.0) + 0.35
    value = value * F.when(n < 4, 0.5).when(n > 50, 0.8).otherwise(1.0)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def parts_of(text: Column, breaks: str) -> Column:
    return F.filter(F.transform(F.split(text, breaks), stripped), lambda x: x != "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def compress(df: DataFrame, ratio: float = 3.0, key: str = "doc_id", text: str = "text", least: int = 20) -> DataFrame:
    """key, short, words_before, words_after and dropped: the densest sentences within a share of each text's words.

    Sentences end at punctuation and at line breaks. They are asked from the
    densest down, ties in order, and each that still fits stays; the first stays
    however long it is. What stays keeps its order. A text of under least words
    or of one sentence stays whole; a null or blank one becomes empty.
    """
    rows = df.select(key, F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("s", parts_of(stripped(F.col("text")), r"(?<=[.!?])\s+|\n+"))
    rows = rows.withColumn("x", F.transform("s", lambda x, i: F.struct((-density(x)).alias("minus"), i.alias("at"), F.size(T.words(x)).alias("size"))))
    rows = rows.withColumn("total", F.aggregate("x", F.lit(0), lambda n, x: n + x["size"]))
    budget = F.greatest(F.lit(1), F.floor(F.col("total") / F.lit(ratio)).cast("int"))

    def ask(kept: Column, x: Column) -> Column:
        used = kept["used"] + x["size"]
        fits = (kept["used"] < kept["budget"]) & ((used <= kept["budget"]) | (F.size(kept["at"]) == 0))
        return F.when(fits, F.struct(kept["budget"].alias("budget"), used.alias("used"), F.concat(kept["at"], F.array(x["at"])).alias("at"))).otherwise(kept)

    none = F.struct(budget.alias("budget"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("at"))
    rows = rows.withColumn("kept", F.aggregate(F.array_sort("x"), none, ask))
    whole = (F.col("total") < least) | (F.size("s") <= 1)
    chosen = F.array_join(F.filter("s", lambda x, i: F.array_contains(F.col("kept")["at"], i)), " ")
    short = F.when(~whole, chosen).when(stripped(F.col("text")) == "", "").otherwise(F.col("text"))
    after = F.when(whole, F.col("total")).otherwise(F.col("kept")["used"])
    dropped = F.when(whole, 0).otherwise(F.size("s") - F.size(F.col("kept")["at"]))
    return rows.select(key, short.alias("short"), F.col("total").alias("words_before"), after.alias("words_after"), dropped.alias("dropped"))


def cost_of(chars: Column, pieces: Column) -> Column:
    """Tokens of a text by its characters and its words and marks; 0 for none."""
    both = F.greatest(F.lit(1), F.floor(chars / 4)) * F.lit(0.4) + F.greatest(F.lit(1), F.floor(pieces * F.lit(1.3))) * F.lit(0.6)
    return F.when(chars == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(both))).cast("int")


def piece_count(text: Column) -> Column:
    return F.size(T.matches(text, r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def rarities(sentences: pd.Series) -> pd.Series:
    """For each sentence of a text the mean over its words of the share of the text's words that are others; 0 without words."""
    out = []
    for own in sentences:
        words = [WORD.findall(x.lower()) for x in own]
        seen = Counter(w for ws in words for w in ws)
        total = sum(seen.values())
        out.append([1 - sum(seen[w] for w in ws) / (total * len(ws)) if ws else 0.0 for ws in words])
    return pd.Series(out)


def compress_to_budget(df: DataFrame, budget: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, short and cost: the sentences of the rarest words, rarest first, until the budget is spent.

    The sentence that doesn't fit any more is cut where four characters a token
    end, if more than 20 characters of room are left. A text within the budget,
    or without words, stays; a null or blank one becomes empty.
    """
    rarity = F.pandas_udf(rarities, "array<double>")
    rows = df.select(key, F.coalesce(text, F.lit("")).alias("text")).withColumn("s", parts_of(F.col("text"), T.SENTENCE_BREAK))
    rows = rows.withColumn("whole", (cost_of(F.length("text"), piece_count(F.col("text"))) <= budget) | (F.size(T.words(F.col("text"))) == 0))
    rows = rows.withColumn("rare", rarity("s"))
    measured = F.zip_with(F.sequence(F.lit(0), F.size("s") - 1), "s", lambda i, x: F.struct((-F.col("rare")[i]).alias("minus"), i.alias("at"), F.length(x).alias("chars"), piece_count(x).alias("pieces")))

    def spend(kept: Column, x: Column) -> Column:
        chars, pieces = kept["chars"] + x["chars"] + 1, kept["pieces"] + x["pieces"]
        state = lambda c, p, at, cut: F.struct(c.alias("chars"), p.alias("pieces"), F.concat(kept["at"], F.array(at)).alias("at"), cut.alias("cut"))
        room = F.lit(4 * budget) - kept["chars"]
        over = state(kept["chars"], kept["pieces"], x["at"], F.when(room > 20, room).otherwise(0))
        return F.when(kept["cut"].isNotNull(), kept).when(cost_of(chars, pieces) > budget, over).otherwise(state(chars, pieces, x["at"], F.lit(None).cast("int")))

    none = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("pieces"), F.array().cast("array<int>").alias("at"), F.lit(None).cast("int").alias("cut"))
    rows = rows.withColumn("kept", F.when(F.size("s") > 0, F.aggregate(F.array_sort(measured), none, spend)))
    at, cut = F.col("kept")["at"], F.col("kept")["cut"]
    last = F.size(at) - 1
    joined_up = F.array_join(F.transform(at, lambda a, i: F.when(cut.isNotNull() & (i == last), F.substring(F.col("s")[a], F.lit(1), cut)).otherwise(F.col("s")[a])), " ")
    short = F.when(stripped(F.col("text")) == "", "").when(F.col("whole"), F.col("text")).otherwise(stripped(joined_up))
    out = rows.select(key, short.alias("short"))
    return out.select(key, "short", cost_of(F.length("short"), piece_count(F.col("short"))).alias("cost"))


#: Least room, in tokens, for which the chunk that no longer fits is cut instead of left out.
ROOM = {"relevance": 50, "summary": 20, "hierarchical": 50}


def fitted(chunks: Column, budget: int, strategy: str) -> Column:
    """The chunks of a query, best first, shortened to a budget of tokens by one of four strategies.

    relevance: an equal share of the budget of each chunk, 50 at least; summary:
    its first two sentences; hierarchical: the first three chunks whole, three
    sentences of the next five, one of the rest; each until the budget is spent,
    the chunk that overflows cut where enough room is left. proposition: all
    sentences of more than 20 characters, one after the other while they fit.
    Blank chunks are left out, null is no chunk. chunks is one query's list.
    """
    texts = F.transform(F.coalesce(chunks, F.array().cast("array<string>")), lambda x, i: F.struct(stripped(F.coalesce(x, F.lit(""))).alias("t"), i.alias("i")))
    held = F.filter(texts, lambda x: x["t"] != "")
    first = lambda text, n: F.array_join(F.slice(T.sentences(text), 1, n), " ")
    if strategy == "proposition":
        sentences = F.filter(F.transform(F.flatten(F.transform(held, lambda x: T.sentences(x["t"]))), stripped), lambda x: F.length(x) > 20)
        none = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("pieces"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))

        def add(state: Column, x: Column) -> Column:
            chars, pieces = state["chars"] + F.length(x) + 1, state["pieces"] + piece_count(x)
            over = state["full"] | (cost_of(chars, pieces) > budget)
            more = F.struct(chars.alias("chars"), pieces.alias("pieces"), F.concat(state["kept"], F.array(x)).alias("kept"), F.lit(False).alias("full"))
            stop = F.struct(state["chars"].alias("chars"), state["pieces"].alias("pieces"), state["kept"].alias("kept"), F.lit(True).alias("full"))
            return F.when(over, stop).otherwise(more)

        return F.aggregate(sentences, none, add, lambda state: F.array_join(state["kept"], " "))
    share = F.greatest(F.lit(50), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.size(texts))).cast("int"))
    cost = lambda text: cost_of(F.length(text), piece_count(text))
    if strategy == "relevance":
        segments = F.transform(held, lambda x: F.struct(F.substring(x["t"], F.lit(1), share * 4).alias("t"), share.alias("cost")))
    elif strategy == "summary":
        segments = F.transform(F.transform(held, lambda x: first(x["t"], 2)), lambda t: F.struct(t.alias("t"), cost(t).alias("cost")))
    elif strategy == "hierarchical":
        short = F.transform(held, lambda x: F.when(x["i"] < 3, x["t"]).when(x["i"] < 8, first(x["t"], 3)).otherwise(first(x["t"], 1)))
        segments = F.transform(short, lambda t: F.struct(t.alias("t"), cost(t).alias("cost")))
    else:
        raise ValueError(f"no strategy {strategy}")
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(False).alias("full"))

    def spend(state: Column, x: Column) -> Column:
        made = lambda used, kept, full: F.struct(used.alias("used"), kept.alias("kept"), F.lit(full).alias("full"))
        room = F.lit(budget) - state["used"]
        whole = made(state["used"] + x["cost"], F.concat(state["kept"], F.array(x["t"])), False)
        cut = F.when(room > ROOM[strategy], F.concat(state["kept"], F.array(F.substring(x["t"], F.lit(1), room * 4)))).otherwise(state["kept"])
        return F.when(state["full"], state).when(x["cost"] > room, made(state["used"], cut, True)).otherwise(whole)

    return F.aggregate(segments, start, spend, lambda state: F.array_join(state["kept"], "\n\n"))
