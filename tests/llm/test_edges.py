"""Rows that every dealt operator must take: nulls, empty and very long texts, repeated rows, clashing columns, ties."""

import random
import time
import zlib
from collections import Counter

import public_tokenizers
import pytest

from loam.llm import fm, katz, lines, minhash, packing, rlz, rules, secrets, tokenizing, transport

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
#: Columns of inputs that have the names of outputs and of inner columns.
CLASH = ("score", "kept", "start", "feature", "block", "node", "n_words", "part", "__text", "ids", "media", "row", "held", "spans")


def some_labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None), (77, 1)], "doc_id long, quality int")


OPERATORS = {
    "op1": lambda df: transport.media_features(df),
    "op2": lambda df: rules.quality_rules(df, some_labels(df.sparkSession)),
    "op3": lambda df: minhash.near_duplicates(df),
    "op4": lambda df: secrets.find_secrets(df),
    "op5": lambda df: packing.pack(df, WORD),
    "op6": lambda df: tokenizing.encode_decode(df, WORD),
    "op7": lambda df: tokenizing.count_tokens(df, BYTE),
    "op8": lambda df: katz.katz_scores(df),
    "op9": lambda df: rlz.kept_words(df),
    "op10": lambda df: fm.quality_scores(df, some_labels(df.sparkSession)),
    "op11": lambda df: lines.kept_lines(df),
}


def odd_rows():
    rng = random.Random(3)
    prose = " ".join(rng.choice(["alpha", "beta.", "gamma", "delta!"]) + str(rng.randrange(99)) for _ in range(80))
    return [(1, prose), (2, prose), (2, prose), (2, "another token=abcdef12"), (None, prose), (None, None), (None, None), (3, None), (4, ""), (5, " \n\t"), (-6, "x"), (7, "\x00 nul ퟿ é 😀")]


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = odd_rows()
    columns = ", ".join(f"`{c}` int" for c in CLASH)
    df = spark.createDataFrame([(*r, *range(len(CLASH))) for r in rows], f"doc_id long, text string, {columns}").repartition(3)
    out = OPERATORS[name](df).collect()
    if name == "op5":  # several pieces a row
        assert {r.doc_id for r in out} == {i for i, _ in rows} and all(r.length > 0 for r in out)
        assert Counter(r.doc_id for r in out if r.start == 0) == Counter(i for i, _ in rows)
    else:
        assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    if name not in ("op3", "op5"):
        by_text = {}
        for r in out:
            if r.doc_id in (1, 3, 4):
                by_text[r.doc_id] = [r[c] for c in r.__fields__ if c not in ("doc_id", "held_out")]
        assert by_text[3] == by_text[4]
        twice = [r for r in out if r.doc_id == 2]
        assert len(twice) == 3 and len({tuple(map(str, r)) for r in twice}) == 2
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    if name != "op5":
        assert Counter(map(str, OPERATORS[name](plain).collect())) == Counter(map(str, out))


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts(spark, name):
    """A word of 200,000 letters, 5 MB of prose and 2 MB of line breaks and hex, within a time limit."""
    rng = random.Random(5)
    word = "".join(rng.choice("etaoinshrdlucm") for _ in range(200_000))
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    prose = " ".join(rng.choice(words) for _ in range(900_000))
    hexes = "\n".join(f"token {rng.getrandbits(128):032x}" for _ in range(50_000))
    df = spark.createDataFrame([(1, word), (2, prose[:5_000_000]), (3, hexes)], "doc_id long, text string").repartition(3)
    began = time.time()
    out = OPERATORS[name](df).collect()
    assert {r.doc_id for r in out} == {1, 2, 3}
    assert time.time() - began < 150


def test_scores_at_the_cutoff(spark):
    """A score equal to the threshold predicts 1; a statistic equal to a cutoff's step is rejected."""
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = spark.createDataFrame([(1, "a b"), (None, "c")], "doc_id long, text string")
    assert [r.predicted for r in fm.quality_scores(df, none, threshold=0.5).collect()] == [1, 1]
    assert [r.predicted for r in fm.quality_scores(df, none, threshold=0.5000001).collect()] == [0, 0]
    held = {r.doc_id: r.held_out for r in fm.quality_scores(df, none).collect()}
    assert held == {1: zlib.crc32(b"1") % 4 == 2, None: False}
    texts = {n: " ".join(["abc#"] * n + [f"w{i:03d}" for i in range(60 - n)]) for n in (5, 6, 7)}
    counted = rules.text_statistics(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    chosen = {1: [("symbols", 256 * 6 // 240)]}
    assert {r.doc_id: r.ok for r in counted.select("doc_id", rules.passed(chosen).alias("ok")).collect()} == {5: True, 6: False, 7: False}


def test_training_rows_are_bounded_by_identifiers(spark):
    """Repeated identifiers give one training row each, whole texts give every feature."""
    long = " ".join(f"w{i}" for i in range(9000))
    df = spark.createDataFrame([(0, long)] * 50 + [(0, "zz"), (3, "good words here")], "doc_id long, text string")
    kept = [i for i in (0, 3) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert kept, "labels of this test must be in the fit"
    seen = []
    original = fm.fit
    fm.fit = lambda rows, wanted: seen.append(rows) or original(rows, wanted)
    try:
        fm.train(df, spark.createDataFrame([(i, i % 2) for i in (0, 3)], "doc_id long, quality int"))
    finally:
        fm.fit = original
    assert len(seen[0]) == len(kept)
    sizes = sorted(len(at) for at, _ in seen[0])
    assert sizes[-1] == len(fm.features(long)[0]) or 0 not in kept
