"""Near duplicates, repeated passages and the language model, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import blocks, katz, minhash, rlz


def words_of(text):
    return (text or "").encode().split()


def planted(seed=3, n=120):
    """Documents with exact copies, near copies, shared passages, nulls and short texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    base, passage, out = make(150), make(60), []
    for i in range(n):
        kind = i % 8
        if kind == 0:
            w = list(base)
        elif kind in (1, 2):
            w = list(base)
            for _ in range(rng.randint(1, 8)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        elif kind == 3:
            w = make(30) + passage[rng.randint(0, 10) :] + make(30)
        elif kind == 4:
            w = make(rng.randint(0, 6))
        else:
            w = make(rng.randint(20, 120))
        out.append((i, rng.choice([" ", "\n"]).join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "A B c d"), (n + 4, "a b C D"), (n + 5, "a b c")]


def near_by_force(rows, k, percent):
    sets, parent = {}, {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in keys}


@pytest.mark.parametrize(("k", "percent"), [(4, 80), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rows = planted()
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, component int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, k, percent).collect()}
    assert got == near_by_force(rows, k, percent)


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = "one two three four five six"
    df = spark.createDataFrame([(7, same), (7, same), (None, same), (None, "lone words here"), (9, "y " * 5000)], "doc_id long, text string")
    got = sorted(minhash.near_duplicates(df, 4).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_shingles))
    assert [(r.doc_id, r.component_id, r.kept) for r in got] == [(7, 7, True), (7, 7, True), (9, 9, True), (None, None, True), (None, 7, False)]


def test_near_duplicates_judges_each_text_of_a_doc_id(spark):
    rng = random.Random(6)
    a, b = (" ".join(str(rng.getrandbits(30)) for _ in range(100)) for _ in "ab")
    rows = [(5, a), (5, b), (1, a + " more"), (2, b + " more"), (1 << 62, a)]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {(5, 97, 1, False), (5, 97, 2, False), (1, 98, 1, True), (2, 98, 2, True), (1 << 62, 97, 1, False)}


def test_near_duplicate_stage_drops_only_copies(spark, sf):
    rng = random.Random(8)
    a, b, other, lone, twin = (" ".join(str(rng.getrandbits(30)) for _ in range(100)) for _ in range(5))
    rows = [(1, a), (None, a + " more"), (None, lone), (3, b), (3, other), (2, b + " more"), (None, twin), (None, twin + " more"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()]
    twins = [x for x in got if x[1] and x[1].startswith(twin)]
    assert len(twins) == 1 and sorted(set(got) - set(twins), key=str) == sorted([(1, a), (None, lone), (3, other), (2, b + " more"), (None, None)], key=str) and len(got) == 6


def test_near_duplicate_stage_on_equal_rows(spark, sf):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(4, text, "b"), (4, text, "a"), (None, text + " more", "c"), (4, "other words of the same row", "d"), (None, None, "e"), (None, None, "f"), (8, " ", "g"), (8, " ", "g"), (4, None, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, first string")
    got = sorted(((r.doc_id, r.first) for r in corpus_pipeline.near_duplicates(spark, df, sf).collect()), key=str)
    assert got == sorted([(4, "a"), (4, "d"), (None, "e"), (None, "f"), (8, "g"), (8, "g"), (4, "h")], key=str)
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), sf).count() == 0


@pytest.mark.parametrize("patience", [0, 10**9])
def test_links_that_no_first_star_finds(spark, patience, monkeypatch):
    """A ring of drifting copies: neighbours are linked, most pairs of a bucket are not."""
    monkeypatch.setattr(minhash, "PATIENCE", patience)
    monkeypatch.setattr(minhash, "CELL", 3)
    monkeypatch.setattr(minhash, "GROUP", 2)
    rng = random.Random(2)
    rows = []
    for ring in range(3):
        w = [f"r{ring}x{rng.randrange(10**6)}" for _ in range(200)]
        for i in range(14):
            rows.append((100 * ring + i, " ".join(w)))
            at = rng.randrange(170)
            w = w[:at] + [f"n{rng.randrange(10**6)}" for _ in range(14)] + w[at + 14 :]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {slack: {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 4, slack=slack).collect()} for slack in (minhash.SLACK, None)}
    assert got[None] == got[minhash.SLACK] == near_by_force(rows, 4, 80)


def test_look_alikes_are_not_all_compared(spark, monkeypatch):
    """Copies of one text that miss the threshold, and copies of those: full sets meet in small buckets and in few pairs only."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]

    def edited(w, n):
        w = list(w)
        for i in rng.sample(range(len(w)), n):
            at = rng.random()
            w[i] = f"x{rng.randrange(10**9)}" if at < 0.7 else f"y{i}" if at < 0.9 else w[i] + f" z{rng.randrange(10**9)}"
        return " ".join(w).split()

    texts = [edited(base, 4) for _ in range(300)]
    texts += [edited(rng.choice(texts), 1) for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rng.shuffle(rows)
    compared, members, stored = [], [], minhash.stored

    def spy(df, name, *more):
        out = stored(df, name, *more)
        if name == "open":
            members.extend(r["count"] for r in out.groupBy("key").count().collect())
        elif members and name == "full":
            compared.extend(r["count"] ** 2 for r in out.groupBy("key").count().collect())
        elif members and name == "pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(minhash, "stored", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 4).collect()}
    assert got == near_by_force(rows, 4, 80)
    large = sum(n * n for n in members if n > minhash.PATIENCE)
    small = sum(n * n for n in members if n <= minhash.PATIENCE)
    assert large > 50_000 and sum(compared) <= small + 0.02 * large


def test_buckets_of_one_family_cost_one(spark, monkeypatch):
    """Look-alikes of two texts, and some that are half of each: a class is told from its family once, not once a bucket."""
    rng = random.Random(8)
    first, second = ([f"{x}{i}" for i in range(120)] for x in "ab")

    def edited(w, n):
        w = list(w)
        for i in rng.sample(range(len(w)), n):
            w[i] = f"x{rng.randrange(10**9)}"
        return w

    texts = [edited(first, 4) for _ in range(120)] + [edited(second, 4) for _ in range(60)] + [edited(first[:60] + second[60:], 2) for _ in range(6)]
    texts += [edited(rng.choice(texts), 1) for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rng.shuffle(rows)
    buckets, told, stored = [], [], minhash.stored

    def spy(df, name, *more):
        out = stored(df, name, *more)
        if name == "open":
            large = out.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {minhash.PATIENCE}")
            buckets.extend((r.key, r.node) for r in out.join(large, "key").collect())
        elif name == "drifts":
            told.append(out.count())
        return out

    monkeypatch.setattr(minhash, "PATIENCE", 8)
    monkeypatch.setattr(minhash, "stored", spy)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 4).collect()}
    assert got == near_by_force(rows, 4, 80)
    classes = len({node for _, node in buckets})
    assert len(buckets) > 4 * classes > 400 and sum(told) <= 1.5 * classes


@pytest.mark.parametrize("alike", [0, 2, 25])
def test_members_of_a_bucket_meet_in_its_family(spark, alike, monkeypatch):
    monkeypatch.setattr(minhash, "ALIKE", alike)
    rng = random.Random(alike)
    rows = [(key, node, node % 5) for key in range(30) for node in rng.sample(range(40), rng.randint(2, 9))]
    placed = defaultdict(set)
    out = minhash.families(spark.createDataFrame(rows, "key long, node long, component long")).collect()
    for r in out:
        placed[r.key].add(r.node)
        assert r.component == r.node % 5
    assert sum(map(len, placed.values())) == len(out) <= len(rows)
    assert all(any({node for k, node, _ in rows if k == key} <= family for family in placed.values()) for key in range(30))


def test_near_duplicates_null_texts_only(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_estimate_follows_similarity(spark):
    rng = random.Random(1)
    for share in (0.5, 0.8, 0.95):
        common = [rng.getrandbits(40) for _ in range(int(400 * share))]
        texts = [" ".join(f"{x:x}" for x in common + [rng.getrandbits(40) for _ in range(400 - len(common))]) for _ in range(2)]
        packed = minhash.signatures(texts, 1)[3]
        row = spark.createDataFrame([([int(x) for x in packed[0]], [int(x) for x in packed[1]])], "a array<long>, b array<long>")
        value = row.select(minhash.estimate(row.a, row.b)).first()[0]
        true = len(common) / (800 - len(common))
        assert abs(value - true) < 0.2


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
    assert minhash.components(edges.limit(0)).count() == 0


def passages_by_force(rows, window):
    count = Counter(tuple(w[i : i + window]) for _, t in rows for w in [words_of(t)] for i in range(len(w) - window + 1))
    out = []
    for key, text in rows:
        w = words_of(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((key, len(w), sum(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [35, 13])
def test_repeated_passages(spark, window):
    rows = planted() + [(900, "again " * 80), (901, "z " * 36), (5, planted()[5][1])]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, block int")
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rlz.kept_words(df, window).collect()), key=str)
    assert got == passages_by_force(rows, window)


def test_passage_factors_and_replacement(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    rows = [(1, f"a b {shared} c", 5), (2, f"{shared}\nd", 5), (3, "alone\nand  kept", 7), (4, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    factors = {r.doc_id: [(f.first_word, f.n_words) for f in r.factors] for r in rlz.duplicate_factors(df).collect()}
    assert factors == {1: [(2, 50)], 2: [(0, 50)], 3: [], 4: []}
    got = {r.doc_id: (r.text, r.n_chars) for r in rlz.replaced(df).collect()}
    assert got == {1: ("a b c", 5), 2: ("d", 1), 3: ("alone\nand  kept", 7), 4: (None, 0)}
    assert rlz.kept_words(df.limit(0)).count() == 0


def test_factors_are_the_greedy_parse():
    """Against a quadratic parse that compares words with the reference's words."""
    rng = random.Random(12)
    window = 5
    for _ in range(60):
        letters = "ab" if rng.random() < 0.3 else "abcdefghijkl"
        shared = [rng.choice(letters) for _ in range(30)]
        texts = []
        for _ in range(rng.randint(2, 7)):
            w = [rng.choice(letters) for _ in range(rng.randint(0, 12))]
            for _ in range(rng.randint(0, 3)):
                a = rng.randrange(25)
                w += shared[a : a + rng.randint(1, 14)] + [rng.choice(letters)]
            texts.append(" ".join(w))
        held = [texts[::2], texts[1::2]]
        made = [rlz.Block(t, window) for t in held]
        own = [x.fingerprints(np.flatnonzero(x.valid)) for x in made]
        sent = [rlz.send(i, a, many, 1, b, places) for i, (a, b, places, many, _) in enumerate(own) if len(a)]
        if not sent:
            continue
        answers = {r["block"]: r["answer"] for r in rlz.answer_windows(pa.concat_tables(sent)).to_pylist()}
        words = [[w.encode() for t in part for w in t.split()] for part in held]
        index, times = {}, Counter()
        for number, x in enumerate(made):
            for p in np.flatnonzero(x.valid).tolist():
                key = tuple(words[number][p : p + window])
                times[key] += 1
                index.setdefault(key, (number, p))
        for number, x in enumerate(made):
            entries = np.full(x.places, -1, rlz.ENTRY)
            if number in answers:
                entries[np.flatnonzero(x.valid)] = np.frombuffer(answers[number], rlz.ENTRY)[own[number][4]]
            got = [f[:5] for f in rlz.factors(x, entries).tolist()]
            wanted = []
            for t, text in enumerate(held[number]):
                w = [y.encode() for y in text.split()]
                i = 0
                while i + window <= len(w):
                    key = tuple(w[i : i + window])
                    if times[key] < 2:
                        i += 1
                        continue
                    b, place = index[key]
                    n = window
                    while i + n < len(w) and words[b][place : place + n + 1] == w[i : i + n + 1] and index.get(tuple(w[i + n + 1 - window : i + n + 1])) == (b, place + n + 1 - window) and times[tuple(w[i + n + 1 - window : i + n + 1])] > 1:
                        n += 1
                    wanted.append((t, i, n, b, place))
                    i += n - window + 1
            assert got == wanted


def test_equal_rows_are_spread_over_blocks(spark):
    same = " ".join(f"s{i}" for i in range(40))
    df = spark.createDataFrame([(None, same)] * 300, "doc_id long, text string")
    packets = blocks.scattered(df, 32).groupBy("block").count().count()
    assert packets == 32
    assert {(r.n_words, r.n_removed) for r in rlz.kept_words(df).collect()} == {(40, 40)}
    assert blocks.repetition(np.array([5, 5, 2, 5, 2])).tolist() == [0, 1, 0, 2, 1]


def test_grams_and_sliding():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 62, 50, dtype=np.uint64)
    for k in (1, 2, 3, 7, 35, 50):
        out = blocks.grams(h, k, 0x9E3779B97F4A7C15)
        for i in (0, len(out) - 1):
            value = 0
            for x in h[i : i + k].tolist():
                value = (value * 0x9E3779B97F4A7C15 + x) % (1 << 64)
            assert int(out[i]) == value
        assert blocks.sliding(h, k, np.minimum).tolist() == [h[i : i + k].min() for i in range(51 - k)]
    assert len(blocks.grams(h, 51, 3)) == 0
    keys = np.unique(blocks.mixed(h))
    for parts in (1, 2, 64):
        pieces = list(blocks.cut(keys, parts))
        assert [b for _, b, _ in pieces] == [0, *(e for _, _, e in pieces[:-1])] and pieces[-1][2] == len(keys)
        assert all((keys[b:e] * parts >> np.uint64(64) == 0).all() if parts == 1 else {int(x) * parts >> 64 for x in keys[b:e]} == {p} for p, b, e in pieces)
    assert list(blocks.cut(keys[:0], 8)) == []
    assert (blocks.expanded(blocks.squeezed(keys)) == keys).all()


class Force:
    """A Katz model from plain dictionaries."""

    def __init__(self, rows):
        self.u, self.b, self.n_docs = Counter(), Counter(), 0
        for i, text in rows:
            if zlib.crc32(str(i).encode() if i is not None else b"") % 10:
                w = [*(text or "").encode().lower().split(), 0]
                self.n_docs += 1
                self.u.update(w)
                self.b.update(zip([1, *w], w, strict=False))
        spread = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
        self.du, self.db = katz.good_turing(spread(self.u)), katz.good_turing(spread(self.b))
        self.n = sum(self.u.values())
        mass = sum(c * self.du[min(c, 6)] for c in self.u.values())
        self.unseen = max(1 - mass / self.n, 1 / (self.n + 1))
        self.scale = (1 - self.unseen) / mass
        self.mass, self.followers = defaultdict(float), defaultdict(float)
        for (h, w), c in self.b.items():
            self.mass[h] += c * self.db[min(c, 6)]
            self.followers[h] += self.word(w)

    def word(self, w):
        c = self.u.get(w, 0)
        return self.scale * c * self.du[min(c, 6)] if c else self.unseen

    def prob(self, h, w):
        seen = self.n_docs if h == 1 else self.u.get(h, 0)
        if not seen:
            return self.word(w)
        left, floor = 1 - self.mass[h] / seen, 1 / (seen + 1)
        c = self.b.get((h, w), 0)
        if c:
            return c * self.db[min(c, 6)] / seen * ((1 - floor) * seen / self.mass[h] if left < floor else 1)
        return max(left, floor) / (1 - self.followers[h]) * self.word(w)


def test_katz_scores(spark):
    rows = planted(n=160)
    df = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    model = Force(rows)
    for h in [1, b"w1", b"w2", b"w3"]:
        assert abs(sum(model.prob(h, w) for w in [*model.u, "unseen"]) - 1) < 1e-9
    got = {r.doc_id: r for r in katz.katz_scores(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        w = [*(text or "").encode().lower().split(), 0]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(w), model.n)
        assert r.n_known == sum(model.u.get(x, 0) > 0 for x in w)
        assert r.base_score == pytest.approx(sum(math.log10((model.u.get(x, 0) + 0.1) / (model.n + 0.1 * (len(model.u) + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(model.prob(h, x)) for h, x in zip([1, *w], w, strict=False)))


def test_katz_edges(spark):
    assert katz.katz_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    out = katz.katz_scores(spark.createDataFrame([(held, "nothing was learned"), (held, None)], "doc_id long, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in out} == {(4, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)}
