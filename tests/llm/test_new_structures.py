"""Line dedup, bounded Lloyd and the prefix trie against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loam.llm import elkan, lines, trie

WHITE = " \t\n\x0b\f\r"


def lines_by_force(rows, least=3, shortest=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WHITE).translate(lower)
    order = lambda i: -(10**30) if i is None else i
    held = defaultdict(set)
    for i, text in rows:
        for x in (text or "").split("\n"):
            if len(key(x)) >= shortest:
                held[key(x)].add(order(i))
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        left = [x for x in own if not (len(held[key(x)]) >= least and max(held[key(x)]) != order(i))]
        out.append((i, len(own), len(own) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return Counter(out)


def line_rows(seed=1, n=90):
    rng = random.Random(seed)
    common = [f"Shared line number {i} with  some words" for i in range(12)]
    out = []
    for i in range(n):
        own = [rng.choice(common) if rng.random() < 0.5 else f"own line {rng.randrange(10**9)} of its text" for _ in range(rng.randint(0, 9))]
        own += [f"\t {x.upper()}\r" for x in rng.sample(common, 2)] + ["short", "", "exactly twenty chars", "nineteen characters"]
        rng.shuffle(own)
        out.append((i, "\n".join(own)))
    hot = "A licence line that a third of all rows hold, more than once"
    return out + [(1000 + i, f"{hot}\nx\n  {hot}  ") for i in range(45)] + [
        (None, common[0]), (None, f"{common[0]}\n{hot}"), (5, None), (6, ""), (7, "\n\n"), (-3, hot), (-3, hot), (1044, f"{hot}\nAgain"), (8, "É" * 20), (9, "é" * 20), (10, "É" * 20), (11, "É" * 20),
        (12, "y" * 300_000 + "\n" + hot), (13, "\n".join([hot] * 3000)),
    ]


@pytest.mark.parametrize("least", [2, 3])
def test_lines_by_brute_force(spark, least):
    rows = line_rows()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, lines int, row int").repartition(5)
    got = Counter(map(tuple, lines.kept_lines(df, least).collect()))
    assert got == lines_by_force(rows, least)


def test_lines_of_small_packets_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(lines, "shard_count", lambda packed: 64)
    rows = line_rows(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert Counter(map(tuple, lines.kept_lines(df).collect())) == lines_by_force(rows)


def test_no_lines(spark):
    assert lines.kept_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = lines.kept_lines(spark.createDataFrame([(1, None)], "doc_id int, text string")).collect()
    assert [tuple(r) for r in one] == [(1, 1, 0, hashlib.sha256(b"").hexdigest())]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 77, 20_000):
        high, low = rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64)
        made = lines.PerfectHash.build(high, low)
        assert sorted(made.numbers(high, low).tolist()) == list(range(n))
        assert sum(made.sizes) < 5 * n + 640


def test_an_index_serves_other_documents(spark):
    """Lines of a new table are looked up in the arrays of an old one; unknown lines hit nothing."""
    old = spark.createDataFrame(line_rows(), "doc_id long, text string")
    packed = lines.packets(old, 3, 20)
    index = lines.line_index(packed, 16, 3).persist()
    new = [(7000, "Shared line number 3 with  some words\nno such line anywhere, I say"), (7001, "nothing known here at all, none")]
    asked = lines.packets(spark.createDataFrame(new, "doc_id long, text string").coalesce(1), 3, 20)
    hits = lines.probed(asked, index, 16, 3).collect()
    assert len(hits) == 1 and len(hits[0].hits) == 16
    index.unpersist()


def codes_by_force(rows, parts=16, entries=64, rounds=2):
    q = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, lab, v in rows]
    ids = sorted({i for i, _, _ in q if i is not None})[:entries]
    first = [min(v for i, _, v in q if i == k) for k in ids]
    width = len(first[0]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in first] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, _, v in q:
                own[near(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else e for k, e in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, lab, v in q:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[lab] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, lab))
    sha = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return Counter((i, code, error, by_label[lab], sha) for i, code, error, lab in out)


def vector_rows(kind, n=400, seed=4, length=32):
    rng = np.random.default_rng(seed)
    if kind == "clusters":
        v = rng.normal(0, 1, (12, length))[rng.integers(0, 12, n)] + rng.normal(0, 0.05, (n, length))
    elif kind == "ties":  # few values: equal distances and repeated vectors everywhere
        v = rng.integers(-1, 2, (n, length)) / 128
    else:
        v = rng.normal(0, 0.1, (n, length))
    return [(int(i), int(rng.integers(0, 3)) or None, [float(np.float32(x)) for x in row]) for i, row in zip(rng.permutation(n) - 50, v, strict=True)]


@pytest.mark.parametrize("kind", ["clusters", "ties", "noise"])
def test_codes_by_brute_force(spark, kind):
    rows = vector_rows(kind)
    rows += rows[:3] + [(None, 1, rows[5][2])]
    odd = [(900, 1, None), (901, 2, []), (902, 1, [float("nan")] * 32), (903, 1, [float("inf")] + [0.0] * 31), (904, 1, [None] * 32), (-99, 1, [1.0] * 31)]
    df = spark.createDataFrame([(*r, 0) for r in rows + odd], "vec_id long, label int, embedding array<float>, code int").repartition(4)
    out, books, measured = elkan.trained(df, 16, 64, 2)
    assert Counter(map(tuple, out.collect())) == codes_by_force(rows)
    assert measured[0] == len(rows) * 16 * 64 and measured[2] < measured[0]
    if kind == "clusters":
        assert measured[2] < measured[0] / 4  # bounds rule out most of them


def test_bounds_are_bounds():
    """After any moves, no upper bound is below and no lower bound above the true distance."""
    rng = np.random.default_rng(1)
    books = rng.integers(-300, 300, (16, 64, 4))
    x = elkan.Bounds.whole(rng.integers(-300, 300, (200, 16, 4)), books)
    for _ in range(5):
        new = books + rng.integers(-20, 20, books.shape)
        x = elkan.Bounds.read(x.vectors, *x.stored(), 64)
        x.moved(elkan.up(np.sqrt(elkan.squared(new, books))))
        x.assign(new)
        books = new
        for p in range(16):
            d = elkan.squared(x.vectors[:, p, None], books[p][None])
            assert (x.codes[:, p] == d.argmin(axis=1)).all()
            assert (x.upper[:, p] >= np.sqrt(d.min(axis=1))).all() and (x.lower[:, p] <= np.sqrt(d)).all()


def test_few_and_huge_vectors(spark):
    kinds = "vec_id long, label int, embedding array<float>"
    assert elkan.compressed(spark.createDataFrame([], kinds)).collect() == []
    assert elkan.compressed(spark.createDataFrame([(1, 1, None)], kinds)).collect() == []
    three = [(3, 1, [0.5] * 16), (1, None, [-0.25] * 16), (2, 1, [0.0] * 16)]
    assert Counter(map(tuple, elkan.compressed(spark.createDataFrame(three, kinds)).collect())) == codes_by_force(three)
    huge = elkan.compressed(spark.createDataFrame([(1, 1, [3e38] * 16), (2, 1, [-3e38] * 16), (3, 2, [1.0] * 16)], kinds)).collect()
    assert len(huge) == 3 and all(r.error >= 0 for r in huge)


def trie_by_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        turns = lambda i: [x[2:] for x in sorted(own.get(i, []))]
        paths[c] = tuple(turns(base)[:h] + turns(c)[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node, m in members.items():
        children[node[:-1]] += bool(node)
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(node))))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def turn_rows(seed=6):
    rng = random.Random(seed)
    opening, second = "You are a helpful assistant.", ["Hello", "Hi é😀", ""]
    out = []
    for c in [*rng.sample(range(0, 900), 150), *range(-150, -60, 7), 200, 300]:
        n = rng.choice([1, 2, 3, 5, 6, 7, 9, 14])
        for t in range(n):
            text = opening if t == 0 else rng.choice(second) if t == 1 else f"turn {rng.randrange(4)}"
            out.append((c, t * rng.choice([1, 1, 2]), "user" if t % 2 else "system", text))
    same = [(c, t, "user", f"copied {t}") for c in range(2000, 2900, 3) for t in range(7)]  # a third of all conversations and more
    odd = [(None, 1, "user", "lost"), (41, None, None, None), (41, None, "user", None), (41, 3, None, "x"), (41, 3, None, "x"), (1700, 0, "user", "")]
    deep = [(3000, t, "user", f"deep {t % 5}") for t in range(120)] + [(3007, t, "user", f"deep {t % 5}") for t in range(90)]
    return out + same + odd + deep


@pytest.mark.parametrize("long", [2000, 5, 60])
def test_trie_by_brute_force(spark, long):
    """The same nodes whether conversations are merged in families or spread over ranges."""
    rows = turn_rows()
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn int, role string, text string, depth int, key1 string").repartition(6)
    got = Counter(map(tuple, trie.prefix_trie(df, long).collect()))
    assert got == trie_by_force(rows)


def test_no_conversations(spark):
    kinds = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], kinds)).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], kinds)).collect() == []
    absent = trie.prefix_trie(spark.createDataFrame([(101, 0, "user", "x")], kinds)).collect()
    assert Counter(map(tuple, absent)) == trie_by_force([(101, 0, "user", "x")])
