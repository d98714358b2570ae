"""Tokenizing against the tokenizers library, and the merging methods against plain merging."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loam.llm import bpe, tokenizing

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = ["", " ", "\n\n ", "<|endoftext|>", "a<|endoftext|> b <|startoftext|>x", "ΑΣ ΣΟΦΟΣ.", "don't I'LL  x\n\n y \t z ", "日本語 テキスト 123 ½²", "é \x1c a\x1fb \x85 \xa0 c", "x" * 3000, "ab" * 1500 + " " + "!?" * 800, "İstanbul ſ K 😀😀 ﬁ", "​ zero line"]


def samples() -> list[str]:
    rng = random.Random(5)
    return TRICKY + ["".join(rng.choice("ab '’sStTdlLre.,!\n\t 09éßΣİ日<|>\x1c\x85\xa0　") for _ in range(rng.randint(1, 60))) for _ in range(300)]


def test_tree_encoder_equals_library():
    library, own = Tokenizer.from_file(WORD), bpe.TreeEncoder(WORD)
    texts = samples()
    for text, ids in zip(texts, own.encode(texts), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted, repr(text[:60])
        assert own.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_heap_counter_equals_library():
    library, own = Tokenizer.from_file(BYTE), bpe.HeapCounter(BYTE)
    for text in samples():
        assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text[:60])


def test_memory_limit_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    texts = ["one two three four five six", "two three seven eight", "one nine"] * 2
    assert [bpe.TreeEncoder(WORD).encode([t])[0] for t in texts] == bpe.TreeEncoder(WORD).encode(texts)


def test_query_columns(spark):
    library = Tokenizer.from_file(WORD)
    rows = [(1, "Hello, World"), (2, None), (None, "x"), (1, "Hello, World")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as n_tokens", "'q' as ids_sha256")
    out = tokenizing.encode_decode(df, WORD).collect()
    assert len(out) == 4 and out[0] == out[3]
    ids = library.encode("Hello, World", add_special_tokens=False).ids
    assert out[0].n_tokens == len(ids)
    assert out[0].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert out[1].n_tokens == 0 and out[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert [r.ids for r in tokenizing.encode(df, WORD).collect()][0] == ids
    counts = tokenizing.count_tokens(df, BYTE, limit=2).collect()
    assert counts[1].n_tokens == 0 and counts[1].n_bytes == 0 and counts[0].over_limit is True


@pytest.mark.parametrize("fn", [tokenizing.encode_decode, tokenizing.count_tokens])
def test_empty_table(spark, fn):
    assert fn(spark.createDataFrame([], "doc_id long, text string"), WORD if fn is tokenizing.encode_decode else BYTE).count() == 0
