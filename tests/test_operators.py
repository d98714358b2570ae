"""Operators on small frames: golden values, ties and edges."""

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import acl, analytics, chunking, compression, evaluation, graph, ranking, vectors, versioning
from loam.plans import registry

HOLDOUT = [
    ("d1 d2 d4 d5 d7 d9 d12", "d1 d2 d4"),
    ("d3 d1 d6 d8 d2 d11 d13", "d1 d2 d3 d6"),
    ("d5 d7 d1 d3 d6 d9 d14", "d1 d5"),
    ("d2 d5 d1 d8 d9 d4 d10", "d1 d2 d4 d8"),
    ("d3 d1 d4 d7 d2 d5 d6", "d1 d2 d3 d4 d7"),
]


def test_golden_holdout(spark):
    got = spark.createDataFrame([(q, d, i + 1) for q, (r, _) in enumerate(HOLDOUT) for i, d in enumerate(r.split())], "query_id int, doc_id string, rank int")
    rel = spark.createDataFrame([(q, d) for q, (_, r) in enumerate(HOLDOUT) for d in r.split()], "query_id int, doc_id string")
    m = evaluation.mean_metrics(evaluation.query_metrics(got, rel)).first()
    assert m.mrr == 1.0 and m.recall_10 == 1.0 and m.recall_20 == 1.0 and m.num_queries == 5
    assert m.recall_5 == pytest.approx(0.95, abs=1e-3) and m.precision_5 == pytest.approx(0.68, abs=1e-3)
    assert m.ndcg_5 == pytest.approx(0.931, abs=1e-3) and m.ndcg_10 == pytest.approx(0.959, abs=1e-3)


def test_metrics_edges(spark):
    got = spark.createDataFrame([(1, 5, 1), (2, 5, 1)], "query_id int, doc_id int, rank int")
    rel = spark.createDataFrame([(2, 9), (3, 1)], "query_id int, doc_id int")
    m = {r.query_id: r for r in evaluation.query_metrics(got, rel).collect()}
    assert (m[1].rr, m[1].recall_5, m[1].ndcg_5) == (None, 1.0, 1.0)
    assert (m[2].rr, m[2].recall_5, m[2].precision_5) == (0.0, 0.0, 0.0)
    assert (m[3].rr, m[3].recall_5) == (0.0, 0.0)


def hits(spark, scores, q=1):
    return spark.createDataFrame([(q, i, float(s)) for i, s in enumerate(scores)], "query_id int, doc_id int, score double")


@pytest.mark.parametrize(
    ("scores", "kept", "level"),
    [([0.32, 0.4, 0.3, 0.27, 0.25], 4, "strong"), ([0.5, 0.3, 0.28], 2, "strong"), ([0.31, 0.3, 0.29, 0.28], 3, "borderline"), ([0.25], 1, "borderline"), ([0.2, 0.1], 0, None), ([], 0, None)],
)
def test_threshold(spark, scores, kept, level):
    out = ranking.threshold(hits(spark, scores)).collect()
    assert len(out) == kept and {r.level for r in out} == ({level} if level else set())


@pytest.mark.parametrize(("scores", "kept"), [([], 0), ([0.9], 1), ([0.9, 0.1], 2), ([0.5] * 6, 3), ([0.9, 0.85, 0.1, 0.05, 0.0], 3), ([1, 0.2, 0.1, 0.05, 0], 2)])
def test_knee(spark, scores, kept):
    assert ranking.knee(hits(spark, scores)).count() == kept


def test_largest_drop(spark):
    assert ranking.largest_drop(hits(spark, [0.9, 0.8, 0.3, 0.2])).first().knee == 2
    assert ranking.largest_drop(hits(spark, [0.9, 0.1])).first().knee == 2
    assert ranking.largest_drop(hits(spark, [0.5, 0.5, 0.5])).first().knee == 3


def test_fusion(spark):
    ranked = lambda s: ranking.ranked(s)
    d, s = ranked(hits(spark, [0.9, 0.8])), ranked(hits(spark, [0.0, 0.7, 0.6]).where("doc_id > 0"))
    both = {r.doc_id: r for r in ranking.fuse(d, s).collect()}
    assert both[1].rrf_score == pytest.approx(1 / 62 + 1 / 61 + 2 / 122) and both[1].score == 0.7
    assert both[0].rrf_score == pytest.approx(1 / 61 + 1 / 122) and both[2].score == 0.6
    plain = {r.doc_id: r.rrf_score for r in ranking.fuse(d, s, sentinel=False).collect()}
    assert plain[0] == pytest.approx(1 / 61)


def test_orders(spark):
    df = spark.createDataFrame([(r, 5) for r in range(1, 6)], "r int, n int")
    assert [x.v for x in df.orderBy("r").select(ranking.interleaved_order(F.col("r"), F.col("n")).alias("v")).collect()] == [0, 4, 1, 3, 2]
    assert [x.v for x in df.orderBy("r").select(ranking.edges_order(F.col("r"), F.col("n")).alias("v")).collect()] == [0, 4, 1, 2, 3]


def test_dense_search_blocks(spark, monkeypatch):
    rows = [(i, [math.cos(i), math.sin(i)]) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    want = {(r.query_id, r.rank): r.doc_id for r in vectors.dense_search(v.where("id % 10 = 0"), v, 4).collect()}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert want == {(r.query_id, r.rank): r.doc_id for r in vectors.dense_search(v.where("id % 10 = 0"), v, 4).collect()}
    for q in (0, 30):
        near = sorted((i for i in range(60) if i != q), key=lambda i: (-round(math.cos(i - q), 5), i))[:4]
        assert {want[q, k] for k in range(1, 5)} == set(near)
    assert vectors.dense_search(v.limit(0), v, 3).count() == 0


def test_multi_vector_search_against_force(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, np.float64).reshape(4, 16) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    unit = {i: v / np.linalg.norm(v, axis=1, keepdims=True) for i, v in rows.items()}
    expected = {}
    for q in (i for i in rows if i % 20 == 0):
        scores = [(-round(float(np.maximum(0, (unit[q] @ unit[d].T).max(axis=1)).mean()), 6), d) for d in rows if d != q]
        expected |= {(q, n): -score for n, (score, _) in enumerate(sorted(scores)[:10], 1)}
    got = {(r.query_id, r.rank): r.max_sim for r in registry.QUERIES["RET11_multi_vector"](spark, sf).collect()}
    assert got == pytest.approx(expected, abs=2e-6)


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (4, 1, 3, 2)] + [("b", 9.0), ("c", None)], "g string, v double")
    out = {r.g: (r.p50, r.p95, r.p99) for r in analytics.percentile(df, ["g"], "v", {"p50": (0.5, 0), "p95": (0.95, 1), "p99": (0.99, 2)}).collect()}
    assert out == {"a": (3.0, 4.0, 4.0), "b": (9.0, 0.0, 0.0)}


def test_trend_and_statistics(spark):
    df = spark.createDataFrame([(5, 0), (0, 0), (15, 10), (5, 10)], "c int, p int")
    assert [r.t for r in df.select(analytics.trend(F.col("c"), F.col("p")).alias("t")).collect()] == ["+∞%", "0%", "+50%", "-50%"]
    assert analytics.p_value(2.0, 10) == pytest.approx(0.07339, abs=1e-4) and analytics.p_value(0.0, 5) == pytest.approx(1.0)
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "k string, v double")
    assert analytics.welch(same, "k", "v", "a", "b").first().p == 1.0 and analytics.effect_size(same, "k", "v", "a", "b").first().d == 0.0
    assert analytics.metric_stats(same.limit(1), ["k"], "v").first()["std"] == 0.0


def test_access(spark):
    cases = [
        ("public", [], [], ["external"], [], "u", True), ("internal", [], [], ["external"], [], "u", False), ("confidential", [], [], ["expert"], [], "u", False),
        ("confidential", [], [], ["expert"], ["g"], "u", True), ("confidential", ["h"], [], ["expert"], ["g"], "u", False), ("restricted", [], ["x"], ["expert"], ["g"], "u", False),
        ("restricted", [], ["x"], ["admin"], [], "u", True), ("public", [], [], [], [], "u", True), ("unknown", [], [], ["viewer"], [], "u", False), (None, [], [], None, None, "u", True),
    ]
    df = spark.createDataFrame(cases, "level string, groups array<string>, users array<string>, roles array<string>, own array<string>, name string, want boolean")
    cols = [F.col(x) for x in ("level", "groups", "users", "roles", "own", "name")]
    assert [r.got for r in df.select(acl.visible(*cols).alias("got")).collect()] == [x[-1] for x in cases]
    assert df.select(acl.document_visible(*cols).alias("got")).collect()[2].got is True


def test_versions(spark):
    df = spark.createDataFrame([("s", "1.10", 1), ("s", "1.9", 2), ("s", "1.10", 3), ("t", "latest", 1), ("t", None, 2), ("d", "2025-01-01", 1)], "source_id string, version string, pos int")
    assert sorted((r.source_id, r.pos) for r in versioning.resolve(df).collect()) == [("d", 1), ("s", 1), ("t", 2)]
    assert sorted((r.source_id, r.pos) for r in versioning.resolve(df, mode="all").where("source_id = 's'").collect()) == [("s", 1), ("s", 3)]
    assert sorted((r.source_id, r.pos) for r in versioning.resolve(df, "1.9").collect()) == [("d", 1), ("s", 2), ("t", 2)]


def test_changes_and_as_of(spark):
    new = spark.createDataFrame([("a", "1"), ("a", "2")], "doc_id string, hash string")
    old = spark.createDataFrame([("a", "2"), ("a", "3"), ("b", "9")], "doc_id string, hash string")
    assert sorted((r.doc_id, r.hash, r.change) for r in versioning.changes(new, old).collect()) == [("a", "1", "added"), ("a", "3", "deleted")]
    h = spark.createDataFrame([("a", "1", 1, "upsert"), ("a", "1", 2, "delete"), ("a", "1", 5, "upsert"), ("a", "2", 3, "upsert")], "doc_id string, hash string, ts int, operation string")
    assert [r.hash for r in versioning.as_of(h, F.lit(4)).collect()] == ["2"] and versioning.as_of(h, F.lit(0)).count() == 0
    assert sorted(r.hash for r in versioning.as_of(h, F.lit(4), legacy=True).collect()) == ["1", "2"]


def test_graph(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (4, 4), (5, 6), (99, 100)] + [(i, i + 1) for i in range(7, 11)], "src long, dst long")
    assert {r.id: r.component for r in graph.components(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7, 10: 7, 11: 7}
    assert {r.id: r.degree for r in graph.degrees(edges.where("src < 3")).collect()} == {0: 2, 1: 2, 2: 2}
    assert graph.existing(edges, nodes).count() == 9
    paths = graph.paths(nodes.where("id in (0, 3)"), edges, 2)
    assert sorted(map(tuple, (r.path for r in paths.collect()))) == [(0, 1, 2), (0, 2, 1), (3,)]


def test_chunking():
    assert chunking.packed_paragraphs("a\n\nb\n\n" + "x" * 100, 10) == ["a\n\nb", "x" * 100]
    assert chunking.overlapped(["aaaa", "bb", "c"], 3)[2].startswith("[previous context: ...\nbb"[:22])
    assert chunking.merged_short(["aaaa", "bbbb", "c" * 400], 5, 50) == ["aaaa\n\nbbbb", "c" * 400]
    assert [k for k, _ in chunking.elements("# h\ntext\n```\ncode\n```\na|b\n---|---\n1|2\n\nend")] == ["header", "paragraph", "code", "table", "paragraph"]
    assert chunking.adaptive("short\n# head\n" + "long " * 60)[0][0] == "header"
    assert chunking.adaptive("") == []
    long = chunking.adaptive("A sentence here. " * 300)
    assert len(long) > 5 and long[1][1].startswith("[previous context: ...")
    units = chunking.code_units("import x\n\n@d\ndef f():\n    pass\n\nclass C:\n    a = 1\n", "python")
    assert [(k, n) for k, n, _ in units] == [("function", "f"), ("class", "C")] and units[0][2].startswith("@d")
    assert chunking.code_units("def (", "python")[0][0] == "module"
    assert [n for _, n, _ in chunking.code_units("export class A {}\nfunction b() {}\n", "javascript")] == ["A", "b"]


def test_sections_and_tree(spark):
    df = spark.createDataFrame([(1, "lost\n# A\nx\n## B\ny"), (2, "plain"), (3, "")], "doc_id int, text string")
    got = [(r.doc_id, r.level, r.heading, r.content) for r in chunking.heading_sections(df).orderBy("doc_id", "position").collect()]
    assert got == [(1, 1, "A", "x"), (1, 2, "B", "y"), (2, 0, "root", "plain"), (3, 0, "root", "")]
    leaves = spark.createDataFrame([(1, i, f"t{i}") for i in range(7)] + [(2, 0, "one")], "doc_id int, pos int, text string")
    levels = {(r.doc_id, r.level): r["count"] for r in chunking.raptor(leaves, levels=4).groupBy("doc_id", "level").count().collect()}
    assert levels == {(1, 0): 7, (1, 1): 2, (1, 2): 1, (2, 0): 1}


def test_compression(spark):
    text = "The quick value is 42. It was so. Nothing of note is in it at all. Engines burn fuel quickly today. " * 3
    texts = spark.createDataFrame([(1, text), (2, ""), (3, "one two"), (4, None), (5, " \n ")], "doc_id int, text string")
    dense = {r.doc_id: tuple(r)[1:] for r in compression.compress(texts).collect()}
    assert dense[1][2] < dense[1][1] and dense[1][3] > 0 and "42" in dense[1][0]
    assert dense[2] == dense[4] == dense[5] == ("", 0, 0, 0) and dense[3] == ("one two", 2, 2, 0)
    rare = {r.doc_id: r for r in compression.compress_to_budget(texts, 30).collect()}
    assert 0 < rare[1].cost <= 40 and rare[1].short != text and rare[3].short == "one two" and rare[4].short == rare[5].short == ""
    df = spark.createDataFrame([(1, "Cats sit. Dogs run. Birds fly. Cats eat fish.", ["cats"]), (2, "One.", ["x"]), (3, "A b. C d. E f. G h.", ["z"]), (4, "A. B. C. D.", []), (5, None, ["x"])], "k int, text string, q array<string>")
    a = {r.k: r.short for r in compression.relevant_sentences(df, ["k"]).collect()}
    assert a == {1: "Cats sit. Cats eat fish.", 2: "One.", 3: "A b. C d. E f.", 4: "A. B. C. D.", 5: ""}
    b = {r.k: r.short for r in compression.top_sentences(df, ["k"], 2).collect()}
    assert b[1] == "Cats sit. Cats eat fish." and b[2] == "One." and b[3] == "A b. C d."


def token_cost(text):
    marks = len(re.findall(r"\w+|[^\w\s]", text))
    return max(1, int(max(1, len(text) // 4) * 0.4 + max(1, int(marks * 1.3)) * 0.6)) if text else 0


def test_density_follows_the_fixed_rule(spark):
    # all content words, no number: 0.5 + 0.35; a number adds 0.15; under four words half, over fifty four fifths
    cases = {"engines burn fuel quickly": 0.85, "engines burn 12 litres": 1.0, "engines burn fuel": 0.425, "the engines of it burn": 0.5 * 2 / 5 + 0.35, " ".join(f"w{'x' * i}" for i in range(60)): 0.8 * 0.85, "...": 0.0}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", compression.density(F.col("s")).alias("d")).collect()
    assert {r.s: r.d for r in rows} == pytest.approx(cases)
    lines = "alpha beta gamma delta\nit is as it was and so on it is\n" * 4
    out = compression.compress(spark.createDataFrame([(1, lines)], "doc_id int, text string")).first()
    assert tuple(out)[1:] == (" ".join(["alpha beta gamma delta"] * 4), 56, 16, 4)


def test_greedy_choices_by_force(spark):
    """Sentences by density within a share of words, and by rarity within a budget, against a plain loop over all places."""
    rng = random.Random(12)
    words = ["the", "of", "it", "engine", "fuel", "pump", "valve", "x9", "42", "naïve", "было", "and"]
    texts = [" ".join("".join([" ".join(rng.choices(words, k=rng.randint(1, 9))), rng.choice([".", "!", "?", "\n", ",", ". "])]) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    parts = lambda pattern, t: [x.strip() for x in re.split(pattern, t.strip()) if x.strip()]

    def weight(x):
        w = re.findall(r"\w+", x.lower())
        value = 0.5 * len(set(w) - compression.EMPTY_WORDS) / len(w) + 0.15 * bool(re.search(r"\d", x)) + 0.35 if w else 0.0
        return min(1.0, value) if not w or 4 <= len(w) <= 50 else min(1.0, value * (0.5 if len(w) < 4 else 0.8))

    dense = {r.doc_id: r for r in compression.compress(df).collect()}
    rare = {r.doc_id: r for r in compression.compress_to_budget(df, 20).collect()}
    for i, t in enumerate(texts):
        own = parts(r"(?<=[.!?])\s+|\n+", t)
        sizes = [len(re.findall(r"\w+", x)) for x in own]
        limit, kept = max(1, int(sum(sizes) / 3)), set()
        if sum(sizes) >= 20 and len(own) > 1:
            for j in sorted(range(len(own)), key=lambda j: (-weight(own[j]), j)):
                used = sum(sizes[k] for k in kept)
                if used < limit and (not kept or used + sizes[j] <= limit):
                    kept.add(j)
            assert dense[i].short == " ".join(own[j] for j in sorted(kept)), t
        else:
            assert dense[i].short == t
        counts = Counter(re.findall(r"\w+", t.lower()))
        if token_cost(t) <= 20:
            assert rare[i].short == t
            continue
        own = [x for x in re.split(r"(?<=[.!?])\s+", t) if x.strip()]
        found = lambda x: re.findall(r"\w+", x.lower())
        mean = lambda x: 1 - sum(counts[w] for w in found(x)) / (len(found(x)) * counts.total()) if found(x) else 0.0
        order, text = sorted(range(len(own)), key=lambda j: (-round(mean(own[j]), 12), j)), ""
        for j in order:
            if token_cost(f"{text}{own[j].strip()} ") > 20:
                text += own[j].strip()[: 80 - len(text)] if 80 - len(text) > 20 else ""
                break
            text += own[j].strip() + " "
        assert rare[i].short == text.strip(), t


def packed_by_force(text, most, least, overlap):
    """Paragraph packing that estimates every joined text anew."""
    chunks = []
    for head, body in chunking.markdown_sections(text):
        held = head
        for part in filter(None, map(str.strip, body.split("\n"))):
            joined = f"{held}\n\n{part}" if held else part
            if held and chunking.tokens(joined) > most:
                chunks.append(held)
                held = head + part
            else:
                held = joined
        if held.strip():
            chunks.append(held)
    if overlap:
        for i in range(1, len(chunks)):
            chunks[i] = f"[previous context: ...{chunks[i - 1][-4 * overlap:]}]\n\n{chunks[i]}"
    out = []
    for x in chunks:
        if out and chunking.tokens(out[-1]) + chunking.tokens(x) <= most and min(chunking.tokens(out[-1]), chunking.tokens(x)) < least:
            out[-1] += "\n\n" + x
        else:
            out.append(x)
    return out


def test_packing_counts_add_up(spark):
    import random

    rng = random.Random(6)
    parts = ["plain words here", "Привет мир", "日本語テキスト", "# One", "## Two more", "### Three", "", "  ", "x" * 90, "#### four"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most, least, overlap in ((20, 5, 0), (60, 30, 4)):
        got = {}
        for r in sorted(chunking.pack_markdown(df, most=most, least=least, overlap=overlap, split=r"\n").collect(), key=lambda r: (r.doc_id, r.position)):
            got.setdefault(r.doc_id, []).append(r.chunk)
            assert r.tokens == chunking.tokens(r.chunk)
        for i, text in enumerate(texts):
            assert got.get(i, []) == packed_by_force(text, most, least, overlap), i


def test_every_chunk_of_a_section_has_its_heading():
    text = "# Guide\n" + "\n\n".join(f"paragraph {i} " + "word " * 30 for i in range(9))
    chunks = chunking.pack_parts(chunking.markdown_sections(text), 90, 5, 0, r"\n\s*\n")
    assert len(chunks) > 3 and all(x[1].startswith("# Guide\n") for x in chunks)


def test_entities_against_force(spark, sf):
    import re

    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    word = r"[A-ZА-Я][A-Za-zА-Яа-я0-9_\-+]{2,}"
    for r in df.select("text", T.entities(F.col("text")).alias("e")).collect():
        runs = [x for x in re.findall(rf"\b{word}(?:\s+{word}){{0,3}}\b", r.text or "") if not re.fullmatch(r"[A-ZА-Я]{2,}", x)]
        assert r.e == list(dict.fromkeys(runs + re.findall(r"\b(v?\d+\.\d+(?:\.\d+)?)\b", r.text or "")))[:10] or r.text is None


def test_extracted_relations(spark):
    df = spark.createDataFrame([(1, "Alpha met Beta."), (2, None)], "doc_id long, text string")
    plain = graph.extracted(df, T.entities(F.col("text"))).collect()
    assert sorted(r.source for r in plain) == ["Alpha", "Beta"] and {r.kind for r in plain} == {"entity"}
    related = graph.extracted(df, T.entities(F.col("text")), lambda texts, names: [[("Alpha", "Beta", "MET"), ("Alpha", "Nobody", "MET")] if "Alpha" in x else [] for x in texts]).where("kind <> 'entity'").collect()
    assert [(r.doc_id, r.source, r.target, r.kind) for r in related] == [(1, "Alpha", "Beta", "MET")]


def test_running_sums_over_ranges(spark):
    rows = [(i % 3 if i % 7 else None, i // 2, i, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, x int, id int, v int")
    got = {(r.g, r.id): (r.s, r.n) for r in analytics.running(df, ["g"], [F.desc("x"), F.col("id")], {"s": F.col("v"), "n": F.lit(1)}, parts=7).collect()}
    last = {r.id: r.k for r in analytics.carried(df, ["g"], [F.desc("x"), F.col("id")], F.when(F.col("id") % 11 == 0, F.col("id")), "k", parts=7).collect()}
    assert len(got) == len(last) == 400
    for g in (0, 1, 2, None):
        total = count = 0
        seen = None
        for _, x, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])):
            assert last[i] == seen
            total, count = total + v, count + 1
            seen = i if i % 11 == 0 else seen
            assert got[g, i] == (total, count)


def test_dense_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    matrix = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "CORPUS_BLOCK", 11)
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in vectors.dense_search(df.where("id % 5 = 0"), df, 4).collect()}
    for q in range(0, 90, 5):
        scores = np.round(matrix @ matrix[q], 6)
        order = [i for i in np.lexsort((np.arange(90), -scores)) if i != q][:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, scores[i]) for i in order]
    zero = spark.createDataFrame([(1, [0.0] * 8), (2, [1.0] * 8)], "id long, embedding array<float>")
    assert {(r.query_id, r.doc_id, r.score) for r in vectors.cosine_search(zero, zero, 2).collect()} == {(1, 2, 0.0), (2, 1, 0.0)}
    assert vectors.dense_search(df.limit(0), df, 3).count() == 0


def test_welch_against_integration():
    """The two-tailed p-value against the integral of Student's density."""
    for t, df in ((0.5, 4.0), (2.1, 11.3), (3.7, 40.0)):
        xs = np.linspace(t, t + 400, 4_000_001)
        const = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        y = const * (1 + xs * xs / df) ** (-(df + 1) / 2)
        tail = 2 * float(((y[1:] + y[:-1]) / 2).sum() * (xs[1] - xs[0]))
        assert analytics.beta_share(df / 2, 0.5, df / (df + t * t)) == pytest.approx(tail, rel=1e-3, abs=1e-6)


def test_text_functions(spark):
    cases = ["", "   ", "Привет, мир!", "日本語", "plain words here", "Ends. Here! Yes?", "x" * 9000]
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    t = F.col("t")
    rows = df.select(T.script_tokens(t).alias("s"), T.bpe_tokens(t).alias("b"), T.token_cost(t).alias("c"), F.size(T.sentences(t)).alias("n"), T.reading_grade(t).alias("g"), T.language(t).alias("l"), T.boilerplate_reason(t).alias("r"), T.coherence(t).alias("h")).collect()
    assert [r.s for r in rows] == [chunking.tokens(x) for x in cases]
    assert [r.c for r in rows] == [token_cost(x) for x in cases]
    assert rows[0].b == 0 and rows[1].b == 1 and rows[5].n == 3 and rows[2].g == 0.0
    assert [r.l for r in rows[2:4]] == ["ru", "zh"] and rows[0].r == "minimal_or_empty_content" and rows[2].r == "too_short_12_chars" and rows[0].h == 0.0
    assert df.select(T.masked_pii(F.lit("me@a.org from 10.0.0.1 " + "k" * 32)).alias("m")).first().m == "[EMAIL] from [IP] [REDACTED]"
    assert json.loads(spark.range(1).select(F.to_json(F.struct(T.detected(F.lit("1 OR 1=1 <script>x</script>"), T.XSS, "xss").alias("x")))).first()[0])["x"] == ["xss_pattern_0"]


def test_calibration(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.6, 1), (0.9, 1)], "score double, label int")
    best = evaluation.calibrated(df).first()
    assert best.threshold == 0.6 and best.f1 == 1.0


def test_grounding(spark):
    df = spark.createDataFrame([(1, "The cat sat on the mat. Quantum flux rises daily.", "a cat sat on a mat"), (2, "", "x")], "id int, answer string, context string")
    out = evaluation.grounding(df).collect()
    assert [(r.id, r.total, r.supported, r.score) for r in out] == [(1, 2, 1, 0.5)]
