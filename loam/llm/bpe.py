"""Byte-pair encoding: segment-tree merging for identifiers, heap merging for counts.

Vocabulary files are read from a path given as parameter, once per Python worker.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from .common import hold, memory

#: Entries of a worker's word memory; beyond that it is emptied and fills anew.
MEMORY = 500_000
#: Longer words are never remembered.
LONGEST = 48

#: Slots of a table of pairs, as a power of two.
SLOT_BITS = 18

#: Fewer words of like length than this are merged one after the other.
SIDE_BY_SIDE = 48

NONE = np.int64(1) << np.int64(62)
LOW = (np.int64(1) << np.int64(32)) - 1

#: White space that str.split takes and Unicode's White_Space does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
UNIT = re.compile(r"\s*\S+|\s+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def is_latin(text: str) -> bool:
    """Whether a text stays within Latin-1."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def latin_words() -> re.Pattern:
    """The encoder's word pattern over Latin-1, as plain character sets."""
    chars = list(map(chr, range(256)))
    letters = re.escape("".join(c for c in chars if unicodedata.category(c)[0] == "L"))
    digits = re.escape("".join(c for c in chars if unicodedata.category(c)[0] == "N"))
    spaces = "\t\n\v\f\r \x85\xa0"
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{digits}]|[^{spaces}{letters}{digits}]+")


class Vocabulary:
    """Merges as symbol numbers: pair (left, right) of rank r becomes made[r]."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in (*ids.items(), *self.special.items()):
            self.tokens[i] = token
        letters = byte_letters()
        self.first = np.array([ids[x] for x in letters], dtype=np.int64)
        self.last = np.array([ids[x + self.suffix] for x in letters], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.width = np.int64(len(self.tokens))
        keys = self.left * self.width + self.right
        self.probes = self.tables(keys)
        self.ranks = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    @staticmethod
    def places(keys: np.ndarray, level: int) -> np.ndarray:
        """Slots of keys in the table of a level."""
        factor = np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0xD1B54A32D192ED03 & (1 << 64) - 1)
        return (keys.astype(np.uint64) * factor >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def tables(self, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hash tables of (key, rank); what finds its slot taken goes on to the next table."""
        found, rest = [], np.arange(len(keys))
        while len(rest):
            slots, first = np.unique(self.places(keys[rest], len(found)), return_index=True)
            held, ranks = np.full(1 << SLOT_BITS, -1, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
            held[slots], ranks[slots] = keys[rest[first]], rest[first]
            found.append((held, ranks))
            rest = np.delete(rest, first)
        return found

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or NONE >> 32 where it can't merge."""
        wanted = np.where((left < 0) | (right < 0), -2, left * self.width + right)
        out = np.full(len(wanted), NONE >> 32)
        for level, (held, ranks) in enumerate(self.probes):
            at = self.places(wanted, level)
            hit = held[at] == wanted
            out[hit] = ranks[at[hit]]
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_by_tree(v: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Identifiers (little-endian, 32 bits) of each word, merged over a segment tree.

    Leaf i of a word's tree holds rank << 32 | i of the pair that begins at symbol
    i, so that the root is the leftmost pair of lowest rank. A merge changes three
    leaves and, above each, one node a level. Many words of like length are merged
    side by side: each step works on one column of every tree that still can
    merge. Few words, as very long ones are, have a tree each.
    """
    out: list[bytes] = [b""] * len(words)
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if word:
            groups.setdefault(max(2, 1 << (len(word) - 1).bit_length()), []).append(i)
    for width, members in groups.items():
        if len(members) < SIDE_BY_SIDE:
            for i in members:
                out[i] = _merge_one(v, words[i], width)
            continue
        step = max(1, 2_000_000 // width)
        for begin in range(0, len(members), step):
            part = members[begin : begin + step]
            for i, ids in zip(part, _merge_group(v, [words[i] for i in part], width), strict=True):
                out[i] = ids
    return out


def _merge_one(v: Vocabulary, word: bytes, width: int) -> bytes:
    """Identifiers of one word of at most width bytes, a power of two."""
    n, none, low = len(word), int(NONE), int(LOW)
    rank, made, total = v.ranks.get, v.made, int(v.width)
    symbols = v.first[np.frombuffer(word, np.uint8)].tolist()
    symbols[-1] = int(v.last[word[-1]])
    after, before = list(range(1, n + 1)), list(range(-1, n))
    tree = [none] * (2 * width)
    for i in range(n - 1):
        if (r := rank(symbols[i] * total + symbols[i + 1])) is not None:
            tree[width + i] = r << 32 | i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, value: int) -> None:
        k = width + i
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            if other < value:
                value = other
            if tree[k] == value:
                return
            tree[k] = value

    while (root := tree[1]) < none:
        i = root & low
        gone = after[i]
        new = symbols[i] = int(made[root >> 32])
        symbols[gone] = -1
        far = after[i] = after[gone]
        before[far] = i
        put(gone, none)
        r = rank(new * total + symbols[far]) if far < n else None
        put(i, none if r is None else r << 32 | i)
        near = before[i]
        if near >= 0:
            r = rank(symbols[near] * total + new)
            put(near, none if r is None else r << 32 | near)
    return np.array([x for x in symbols if x >= 0], "<u4").tobytes()


def _merge_group(v: Vocabulary, words: list[bytes], width: int) -> list[bytes]:
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
    columns = np.arange(width)
    inside = columns < lengths[:, None]
    symbols = np.where(inside, v.first[raw], -1)
    symbols[np.arange(n), lengths - 1] = v.last[raw[np.arange(n), lengths - 1]]
    # one column more: the symbol after the last, which never pairs
    symbols = np.concatenate([symbols, np.full((n, 1), -1)], axis=1)
    after = np.minimum(np.broadcast_to(columns + 1, (n, width)), lengths[:, None]).copy()
    after[after >= lengths[:, None]] = width
    before = np.broadcast_to(np.arange(width + 1) - 1, (n, width + 1)).copy()
    tree = np.full((n, 2 * width), NONE)
    ranks = v.rank(symbols[:, :width].ravel(), symbols[:, 1:].ravel()).reshape(n, width)
    ranks[columns >= (lengths - 1)[:, None]] = NONE >> 32
    tree[:, width:] = np.where(ranks < NONE >> 32, ranks << 32 | columns, NONE)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    alive = inside.copy()
    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        root = tree[rows, 1]
        at = root & LOW
        gone = after[rows, at]
        new = v.made[root >> 32]
        symbols[rows, at] = new
        alive[rows, gone] = False
        far = after[rows, gone]
        after[rows, at] = far
        before[rows, far] = at
        near = before[rows, at]
        right = np.where(far < width, symbols[rows, far], -1)
        left = np.where(near >= 0, symbols[rows, near], -1)
        follows = v.rank(new, right)
        precedes = v.rank(left, new)
        tree[rows, width + gone] = NONE
        tree[rows, width + at] = np.where(follows < NONE >> 32, follows << 32 | at, NONE)
        has = near >= 0
        if has.all():
            tree[rows, width + near] = np.where(precedes < NONE >> 32, precedes << 32 | near, NONE)
        else:
            tree[rows[has], width + near[has]] = np.where(precedes < NONE >> 32, precedes << 32 | near, NONE)[has]
        spots = [width + gone, width + at, width + np.where(has, near, at)]
        while spots[0][0] > 1:
            spots = [s >> 1 for s in spots]
            for s in spots:
                tree[rows, s] = np.minimum(tree[rows, 2 * s], tree[rows, 2 * s + 1])
        rows = rows[tree[rows, 1] < NONE]
    ids = symbols[:, :width][alive].astype("<u4").tobytes()
    ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class TreeEncoder:
    """Texts to identifiers as a lower-casing vocabulary with word ends defines them."""

    #: The vocabulary's own pattern for words.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.pattern = regex.compile(self.PATTERN)
        self.latin = latin_words()
        self.words: dict[str, bytes] = memory("tree")

    def normalised(self, text: str) -> str:
        """Composed form, then each character's own lower case (no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def split(self, text: str) -> list[str]:
        text = self.normalised(text)
        return (self.latin if is_latin(text) else self.pattern).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Identifiers of each text as little-endian 32-bit integers.

        Words not remembered are merged together, a run of texts at a time.
        """
        hold("tree")
        known, special = self.words, self.v.special
        if len(known) > MEMORY:
            known.clear()
        found: list[list[list[bytes | None]]] = []
        gaps: list[tuple[list, list[str], list[int]]] = []
        for text in texts:
            parts: list[list[bytes | None]] = []
            for p in self.v.splitter.split(text) if any(x in text for x in special) else (text,):
                if p in special:
                    parts.append([special[p].to_bytes(4, "little")])
                elif p:
                    words = self.split(p)
                    ids = list(map(known.get, words))
                    if None in ids:
                        gaps.append((ids, words, [i for i, x in enumerate(ids) if x is None]))
                    parts.append(ids)
            found.append(parts)
        new = list({words[i] for _, words, places in gaps for i in places})
        learned = dict(zip(new, merge_by_tree(self.v, [w.encode() for w in new]), strict=True))
        for ids, words, places in gaps:
            for i in places:
                ids[i] = learned[words[i]]
        known.update((w, x) for w, x in learned.items() if len(w) <= LONGEST)
        return [b"".join(parts[0]) if len(parts) == 1 else b"".join(map(b"".join, parts)) for parts in found]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space: this vocabulary has no decoder of its own."""
        return " ".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class HeapCounter:
    """Numbers of tokens under a byte-level vocabulary; no identifiers are made."""

    #: The byte-level pattern for words.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.pattern = regex.compile(self.PATTERN)
        width = int(self.v.width)
        self.width = width
        self.first = self.v.first.tolist()
        self.rank = {a * width + b: r for r, (a, b) in enumerate(zip(self.v.left.tolist(), self.v.right.tolist(), strict=True))}
        self.made = self.v.made.tolist()
        self.units: dict[str, int] = memory("heap")
        self.words: dict[str, int] = memory("heap")

    def merged(self, word: bytes) -> int:
        """Initial symbols minus merges.

        The heap holds rank * n + position of every pair that can merge; symbols
        form a linked list. An entry whose pair has changed since is skipped.
        """
        n = len(word)
        if n < 2:
            return n
        rank, made, width = self.rank.get, self.made, self.width
        symbols = [self.first[b] for b in word]
        after = list(range(1, n + 1))
        before = list(range(-1, n))
        heap = []
        for i in range(n - 1):
            if (r := rank(symbols[i] * width + symbols[i + 1])) is not None:
                heap.append(r * n + i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        left = n
        while heap:
            r, i = divmod(pop(heap), n)
            j = after[i]
            if symbols[i] < 0 or j >= n or rank(symbols[i] * width + symbols[j]) != r:
                continue
            new = symbols[i] = made[r]
            symbols[j] = -1
            k = after[i] = after[j]
            before[k] = i
            left -= 1
            if k < n and (r := rank(new * width + symbols[k])) is not None:
                push(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] * width + new)) is not None:
                push(heap, r * n + h)
        return left

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.merged(word.encode())
            if len(word) <= LONGEST:
                if len(self.words) > MEMORY:
                    self.words.clear()
                self.words[word] = n
        return n

    def unit(self, unit: str) -> int:
        n = sum(map(self.word, self.pattern.findall(unit)))
        if len(unit) <= LONGEST:
            self.units[unit] = n
        return n

    def count(self, text: str) -> int:
        hold("heap")
        total = 0
        if len(self.units) > MEMORY:
            self.units.clear()
        for piece in self.v.splitter.split(text):
            if piece in self.v.special:
                total += 1
            elif ODD_SPACE.search(piece):
                total += sum(map(self.word, self.pattern.findall(piece)))
            else:
                known = self.units.get
                for u in UNIT.findall(piece):
                    total += known(u) or self.unit(u)
        return total


@lru_cache(maxsize=2)
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


@lru_cache(maxsize=2)
def heap_counter(path: str) -> HeapCounter:
    return HeapCounter(path)
