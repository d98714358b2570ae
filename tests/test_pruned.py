"""Searches and lookups that prune, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loam.operators import pruned, similarity, vectors


def near_texts(seed, n):
    """Long texts, near copies of them, texts that look alike without matching, and short ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    bases = [rng.sample(vocabulary, size) for size in (25, 60, 150, 400)]
    rows = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            w = rng.sample(vocabulary, rng.randint(15, 60))
        else:
            w = list(rng.choice(bases))
            for _ in range(rng.randint(0, max(1, len(w) // (12 if kind == 1 else 30)))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            w = w[: len(w) - rng.randint(0, len(w) // 25)]
            rng.shuffle(w)
        rows.append((i, " ".join(w)))
    hot = " ".join(bases[2])
    return rows + [(n + i, f" {hot.upper()} " if i % 2 else f"{hot} {hot.split()[i]}") for i in range(n // 3)]


def first_match_by_force(rows):
    rows = [(i, t) for i, t in rows if i is not None and t is not None]
    sets = [(i, t.strip(" \t\n\x0b\f\r").lower(), set(re.split(r"[ \t\n\x0b\f\r]+", t.lower())) - {""}) for i, t in rows]
    out = []
    for i, key, own in sets:
        same = [j for j, k, _ in sets if j < i and k == key]
        near = [j for j, _, other in sets if j < i and own and other and len(own & other) / max(len(own), len(other)) >= 0.95 - 1e-12]
        if same or near:
            out.append((i, min(same or near), bool(same)))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_first_matches(spark, seed):
    rows = near_texts(seed, 240) + [(None, "no id"), (5000, None), (5001, ""), (5002, " "), (5003, "one two"), (5003, "One two "), (5004, "two one"), (5005, "one two")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = Counter((r.id, r.hit, r.exact) for r in similarity.first_matches(df).collect())
    want = first_match_by_force(rows)
    assert got == want and sum(n for (_, _, exact), n in want.items() if not exact) > 60
    assert similarity.first_matches(df.limit(0)).count() == 0


def test_matching_sets_share_a_signature(spark):
    """Every pair of sets at 95 % has a signature in common, at the very edge too; few other pairs do."""
    rng = random.Random(3)
    rows, pairs = [], []
    for n in (19, 20, 21, 39, 40, 41, 100, 333, 1000):
        for size in {n, math.ceil(0.95 * n)}:
            a = rng.sample(range(10**6), n)
            need = -(-19 * n // 20)
            b = a[:need] + rng.sample(range(10**6, 2 * 10**6), size - need)
            pairs.append((len(rows), len(rows) + 1, need >= 0.95 * max(n, size)))
            rows += [(len(rows), sorted(a)), (len(rows) + 1, sorted(b))]
    keys = defaultdict(set)
    for r in similarity.signatures(spark.createDataFrame(rows, "first long, words array<long>")).collect():
        keys[r.first].add(r.signature)
    for a, b, match in pairs:
        if match and len(rows[a][1]) > 19 and rows[a][1] != rows[b][1]:
            assert keys[a] & keys[b], (len(rows[a][1]), len(rows[b][1]))
    alike = sum(bool(keys[a] & keys[b]) for a in keys for b in keys if a < b)
    assert alike <= len(pairs) + 2


def lexical_by_force(queries, corpus, k):
    find = lambda t: re.findall(r"\w+", t.lower())
    counts = {i: Counter(find(t or "")) for i, t in corpus}
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for q, text in queries:
        words = set(find(text))
        scores = [(-round(sum((1 + math.log(c[w])) * math.log(1 + len(corpus) / df[w]) for w in words if c[w]), 6), i) for i, c in counts.items() if any(c[w] for w in words)]
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("shard", [16, 4096])
def test_lexical_top(spark, monkeypatch, shard):
    rng = random.Random(7)
    monkeypatch.setattr(pruned, "SHARD", shard)
    monkeypatch.setattr(pruned, "QUERIES", 7)
    weights = [1 / (i + 1) for i in range(300)]
    make = lambda n: " ".join(f"t{i}" for i in rng.choices(range(300), weights, k=n))
    corpus = [(i, make(rng.randint(1, 60))) for i in range(300)] + [(300, None), (301, "")]
    queries = [(i, make(rng.randint(1, 8)) + f" t{rng.randrange(200, 300)} unknown{i}") for i in range(40)] + [(99, "nothingknown")]
    frames = [spark.createDataFrame(x, "id long, text string").repartition(3) for x in (queries, corpus)]
    got = defaultdict(list)
    for r in sorted(pruned.lexical_top(*frames, 5).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.doc_id, r.score))
    want = lexical_by_force(queries, corpus, 5)
    assert got.keys() == {q for q, hits in want.items() if hits}
    for q, hits in got.items():
        assert [i for i, _ in hits] == [i for i, _ in want[q]] and [s for _, s in hits] == pytest.approx([s for _, s in want[q]], abs=2e-6)
    met = pruned.lexical_rows(*frames, 5).agg({"met": "sum"}).first()[0]
    shares = sum(1 for _, q in queries for _, d in corpus if set(q.split()) & set((d or "").split()))
    print("documents met", met, "of", shares, "that share a word")
    assert met < 0.75 * shares


def tokens_of(rng, centres, n):
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.02, (n, centres.shape[1]))
    return x.astype(np.float32).tolist()


def test_multi_vector_search(spark, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(pruned, "SHARD", 100)
    monkeypatch.setattr(pruned, "QUERIES", 3)
    centres = rng.normal(size=(40, 24))
    rows = [(i, tokens_of(rng, centres, int(rng.integers(1, 6)))) for i in range(400)]
    odd = [(900, []), (901, None), (902, [[0.0] * 24]), (None, rows[0][1]), (903, [rows[3][1][0], None])]
    df = spark.createDataFrame(rows + odd, "id long, vectors array<array<float>>").coalesce(2)
    found = pruned.multi_vector_search(df.where("id % 20 = 0"), df, 6).collect()
    unit = {i: [np.array(v) / np.linalg.norm(v) if v and np.linalg.norm(v) else np.zeros(24) for v in vs or []] for i, vs in rows + odd if i is not None}
    for q in range(0, 400, 20):
        scores = [(-round(sum(max([0.0, *(float(a @ b) for b in unit[d])]) for a in unit[q]) / len(unit[q]), 5), d) for d in unit if d != q]
        own = sorted((r["rank"], r.doc_id, r.max_sim) for r in found if r.query_id == q)
        assert [s for _, _, s in own] == pytest.approx([-s for s, _ in sorted(scores)[:6]], abs=2e-5)
        by_id = {d: -s for s, d in scores}
        assert all(by_id[d] == pytest.approx(s, abs=2e-5) for _, d, s in own)
    scored = pruned.multi_vector_rows(df.where("id % 20 = 0 and id < 400"), df, 6).agg({"scored": "sum"}).first()[0]
    print("rows scored in full", scored, "of", 20 * 400)
    assert scored < 0.6 * 20 * 400
    assert pruned.multi_vector_search(df.limit(0), df.limit(0), 3).count() == 0


def test_similar_before(spark, monkeypatch):
    rng = np.random.default_rng(9)
    monkeypatch.setattr(pruned, "LOG", 8)
    bases = rng.normal(size=(12, 16))
    rows = [(i, float(rng.integers(0, 4000)), (bases[rng.integers(0, 12)] + rng.normal(0, 0.16, 16)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i + 1000, t, v) for i, t, v in rows[:20]] + [(2000, 50.0, rows[0][2][:8]), (2001, 60.0, rows[0][2][:8])]
    odd = [(3000, 10.0, None), (3001, 10.0, []), (3002, 10.0, [0.0] * 16), (3003, None, rows[0][2]), (None, 9.0, rows[0][2]), (3004, 5.0, [float("nan")] * 16)]
    df = spark.createDataFrame(rows + odd, "id long, ts double, embedding array<float>").repartition(4)
    got = {(r.id, r.ts): (r.hit, round(r.score, 5)) for r in pruned.similar_before(df, 0.95, 900.0).collect()}
    unit = [(i, t, np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))) for i, t, v in rows]
    want = {}
    for i, t, x in unit:
        near = [(-round(float(x @ y), 6), s, j) for j, s, y in unit if 0 < t - s <= 900 and len(x) == len(y)]
        near = [n for n in near if n[0] <= -0.95]
        if near:
            want[i, t] = (min(near)[2], round(-min(near)[0], 5))
    assert got == want and 50 < len(want) < 322
    blocks = pruned.log_blocks(df, 900.0).persist()
    n, pairs = blocks.count(), pruned.block_pairs(blocks, 0.95, 900.0).count()
    print("pairs of blocks", pairs, "of", n * n)
    assert pairs < 0.25 * n * n
    blocks.unpersist()


def test_dense_search_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [2.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    got = {(r.query_id, r.doc_id, r.score) for r in vectors.dense_search(df, df, 3).collect()}
    assert got == {(1, 2, 0.5), (2, 1, 0.5), (4, 7, 2.0), (7, 4, 2.0)}


def test_evidence_is_the_first_sentence_that_supports(spark):
    from loam.operators import evaluation

    rng = random.Random(6)
    words = [f"w{i}" for i in range(25)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows = []
    for i in range(25):
        context = " ".join(f"{say(rng.randint(1, 9))}{rng.choice('.!?')}" for _ in range(rng.randint(1, 20)))
        answer = " ".join(f"{say(rng.randint(3, 8))}." for _ in range(rng.randint(1, 8)))
        rows.append((i, answer, context))
    rows += [(100, "This claim stands against nothing.", ""), (101, "", "a context"), (102, None, None), (103, "short", "short")]
    df = spark.createDataFrame(rows, "id long, answer string, context string")
    got = {r.id: r for r in evaluation.hallucinations(df).collect()}
    assert (got[100].rate, got[100].total, list(got[100].evidence)) == (1.0, 1, []) and got[101].total == got[102].total == got[103].total == 0

    def supported(claim, context):
        a, b = set(re.findall(r"\w+", claim.lower())), set(re.findall(r"\w+", context.lower()))
        return bool(a and b) and 0.5 * len(a & b) / math.sqrt(len(a) * len(b)) + 0.5 * len(a & b) / len(a) >= 0.3 - 1e-12

    for i, answer, context in rows[:25]:
        claims = [x.strip().rstrip(";.") for x in re.split(r"(?<=[.!?])\s+", answer)]
        claims = [x for x in claims if len(x) >= 10]
        yes = [x for x in claims if supported(x, context)]
        assert list(got[i].supported) == yes and got[i].total == len(claims) and list(got[i].hallucinated) == [x for x in claims if x not in yes]
        assert list(got[i].evidence) == [next((s.strip() for s in re.split(r"(?<=[.!?])\s+", context) if supported(x, s)), "context") for x in yes]


def test_first_within_against_force(spark, monkeypatch):
    """Small blocks, so that heads leave rows to the later blocks; copies, repeated and missing ids, odd vectors."""
    rng = np.random.default_rng(5)
    near = rng.normal(size=(300, 4)) / 3
    rows = [(int(rng.integers(0, 250)), f"k{i % 3}", [float(x) for x in np.float32(v)]) for i, v in enumerate(near)]
    # a key whose head points away from all later rows, with many copies of vectors near to nothing and to one another
    rows += [(i, "far", [-1.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(i, "far", [0.0, 1.0, 0.0, 0.0]) for i in range(40, 70)] + [(i, "far", [0.0, 0.0, 0.1, 0.0]) for i in range(60, 100)]
    rows += [(1, "k0", None), (2, "k0", []), (3, None, [1.0] * 4), (None, "k0", [1.0] * 4), (4, "k0", [1.0, None, 1.0, 1.0]), (500, "k0", [1.0] * 3), (501, "k0", [1.0] * 3)]
    sound = [(i, k, v) for i, k, v in rows if i is not None and k is not None and v and None not in v]
    want = {}
    for i, k, v in sound:
        found = [j for j, other, u in sound if j < i and other == k and len(u) == len(v) and round(sum(a * b for a, b in zip(u, v)), 6) >= 0.2]
        if found:
            want[i] = min(found + [want.get(i, found[0])])
    df = spark.createDataFrame(rows, "id long, key string, embedding array<float>").repartition(5)
    for most, copy in ((8, 2), (1024, 32)):
        monkeypatch.setattr(pruned, "COPY", copy)
        got = pruned.first_within(df, 0.2, most).collect()
        assert len(got) == len(want) and {r.id: r.hit for r in got} == want
    assert pruned.first_within(df.limit(0), 0.2).count() == 0


def test_semantic_cache_has_no_pairs_of_rows(spark, sf):
    """Only blocks are joined: no row of the plan is a pair of vectors."""
    from loam.plans import registry

    plan = registry.QUERIES["RET06_semantic_cache"](spark, sf)._jdf.queryExecution().toString()
    assert "zip_with" not in plan
