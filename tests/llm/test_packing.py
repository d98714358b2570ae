"""Packing: every identifier once, no gaps, and least cost against all ways of cutting."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loam.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def cost_of(at, cost, size, free, cuts):
    total, begin = 0.0, at[0]
    for cut in cuts:
        n = cut - begin
        if n > size:
            return float("inf")
        total += (0 if n in free else size - n) + cost[at.index(cut)]
        begin = cut
    return total


def test_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(150):
        size = rng.choice([8, 16])
        at = [rng.randint(0, 9)]
        for _ in range(rng.randint(1, 10)):
            at.append(at[-1] + rng.randint(1, size))
        cost = [0.0, *(rng.choice([0, 2, 7]) for _ in at[1:])]
        free = (size // 2,)
        got = packing.choose_cuts(at, cost, size, free)
        ways = (list(c) + [at[-1]] for n in range(len(at) - 1) for c in itertools.combinations(at[1:-1], n))
        assert cost_of(at, cost, size, free, got) == min(cost_of(at, cost, size, free, w) for w in ways)


def check(rows, texts, size):
    library = Tokenizer.from_file(WORD)
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
    for pieces in sequences.values():
        place = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == place and r.length > 0
            place += r.length
        assert place <= size
    for key, text in texts.items():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        place = 0
        for r in sorted(documents[key], key=lambda r: r.start):
            assert r.start == place and r.doc_tokens == len(ids)
            place += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : place].tobytes())
        assert place == len(ids)
    fills = [sum(r.length for r in p) for p in sequences.values()]
    return sum(0 if f.bit_count() == 1 else size - f for f in fills) / max(1, sum(fills))


def test_whole_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    padding = check(packing.pack(df, WORD).collect(), {r.doc_id: r.text for r in df.collect()}, 2048)
    assert padding < 0.02


def test_edges(spark):
    texts = {1: None, 2: "", 3: "word " * 3000, 4: "a. b! c?", 5: "a. b! c?"}
    df = spark.createDataFrame([(k, v, 9) for k, v in texts.items()], "doc_id long, text string, offset int")
    check(packing.pack(df, WORD, size=64).collect(), texts, 64)
    assert packing.pack(df.limit(0), WORD).count() == 0
    twice = packing.pack(df.where("doc_id = 4").union(df.where("doc_id = 4")), WORD).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


def test_settled_windows_are_those_of_the_whole_stream():
    """However often settled windows are given out, the cuts are those of one run over everything."""
    rng = random.Random(1)
    for every in (1, 7, 40):
        docs = []
        for k in range(300):
            n = rng.choice((3, 60, 300, 900))
            ends = [] if rng.random() < 0.2 else sorted(rng.sample(range(1, n + 1), min(n, rng.randint(1, 12))))
            docs.append((k, np.full(n, k, "<u4"), np.array(ends, dtype=int)))
        whole, parted = packing.Packer(512, 0), packing.Packer(512, 0)
        made, held = [], 0
        for i, (k, ids, ends) in enumerate(docs):
            whole.add(k, ids, ends)
            parted.add(k, ids, ends)
            if i % every == 0:
                made += parted.cut(False)
            held = max(held, len(parted.docs))
        made += parted.cut(True)
        assert made == list(whole.cut(True))
        assert held < 60


def test_only_sentences_longer_than_a_window_are_cut_inside():
    rng = random.Random(4)
    size = 64
    packer, allowed = packing.Packer(size, 0), {0}
    for k in range(80):
        lengths = [rng.choice((1, 5, 20, 63, 64, 65, 200)) for _ in range(rng.randint(1, 6))]
        ends = np.cumsum(lengths)
        before = np.concatenate([[0], ends[:-1]])
        for a, b in zip(before.tolist(), ends.tolist(), strict=True):
            allowed |= {packer.end + b} | (set(range(packer.end + a, packer.end + b)) if b - a > size else set())
        packer.add(k, np.full(int(ends[-1]), k, "<u4"), ends[:-1])
    stops, place = [], 0
    cut = packer.cuts.rest()
    assert set(cut) <= allowed and cut[-1] == packer.end
    for r in packer.cut(True):
        assert r[6] == 0 or place + r[2] <= size
        place = r[2] if r[6] == 0 else place + r[2]
        stops.append(r)
    assert sum(r[2] for r in stops) == packer.end


def test_very_long_texts(spark):
    texts = {1: "abcdefghij" * 20_000, 2: "many words without an end " * 20_000, None: "lost. " * 500}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(packing.pack(df, WORD).collect(), texts, 2048)
