"""Operators 6 and 7: byte-pair encoding, decoding and counting over whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .bpe import heap_counter, tree_encoder
from .common import as_bytes, map_texts


def encode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int): the identifiers of each text under the vocabulary at path.

    Pairs are merged over a segment tree of pair ranks. A null text reads as
    empty and has no identifiers; equal rows give equal rows; other columns of df
    are left out, so none can clash. No shuffle; a worker holds one slice of texts.
    """

    def run(texts: list[str]) -> list[list]:
        return [[np.frombuffer(x, "<i4") for x in tree_encoder(path).encode(texts)]]

    return map_texts(df, run, "ids array<int>", keep, text)


def encode_decode(df: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Encode each text, decode its identifiers, and return the digest of both.

    Columns: keep, n_tokens long, ids_sha256 (of little-endian unsigned 32-bit
    identifiers), decoded_sha256 (of the decoded text in UTF-8). A null text
    reads as empty: 0 tokens and the digests of nothing.
    """

    def run(texts: list[str]) -> list[list]:
        encoder = tree_encoder(path)
        ids = encoder.encode(texts)
        sha = hashlib.sha256
        return [
            [len(x) // 4 for x in ids],
            [sha(x).hexdigest() for x in ids],
            [sha(encoder.decode(x).encode("utf-8", "replace")).hexdigest() for x in ids],
        ]

    return map_texts(df, run, "n_tokens long, ids_sha256 string, decoded_sha256 string", keep, text)


def count_tokens(
    df: DataFrame, path: str, limit: int = 512, keep: tuple[str, ...] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """Number of tokens of each text, by heap and linked list, without identifiers.

    Columns: keep, n_bytes long (UTF-8), n_tokens long, over_limit boolean. A
    null text reads as empty: 0 and false.
    """

    def run(texts: list[str]) -> list[list]:
        counts = list(map(heap_counter(path).count, texts))
        return [[len(as_bytes(t)) for t in texts], counts, [n > limit for n in counts]]

    return map_texts(df, run, "n_bytes long, n_tokens long, over_limit boolean", keep, text)
