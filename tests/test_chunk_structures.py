"""Heading trees, chunk contexts, the mention sketch and the seeded split, against brute force."""

import random
import time
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loam.operators import analytics, chunking, sketches


def test_heading_tree_of_random_levels(spark):
    rng = random.Random(1)
    docs = [[(rng.randint(1, 6), f"h{rng.randrange(8)}") for _ in range(rng.randint(0, 40))] for _ in range(30)] + [[(6 - i % 6, "x") for i in range(60)]]
    df = spark.createDataFrame([(i, [{"level": n, "text": t} for n, t in d], 7) for i, d in enumerate(docs)] + [(99, None, 7)], "doc_id int, headings array<struct<level:int,text:string>>, parent int").drop("parent")
    got = {(r.doc_id, r.position): (r.level, r.heading, r.parent, list(r.children)) for r in chunking.heading_tree(df).collect()}
    want = {}
    for d, headings in enumerate(docs):
        parents = []
        for i, (level, _) in enumerate(headings):
            parents.append(next((j for j in range(i - 1, -1, -1) if headings[j][0] < level), -1))
        for i, h in enumerate(headings):
            first = headings.index(h)
            want[d, i] = (*h, parents[i], [headings[j][1] for j in range(len(headings)) if parents[j] == first])
    assert got == want
    one = chunking.heading_chunks(df.where("doc_id = 30"), F.lit("T")).where("position = 5").first().chunk
    assert one.startswith("Document: T\n# x\nSections: x, x")


def context_by_force(text, chunk, title):
    at = text.find(chunk)
    if at < 0:
        return f"Document: {title}\n\n{chunk}"
    heading = ""
    for m in re.finditer(r"(?m)^#{1,3}[ \t]+(\S.*)$", text):
        heading = m[1].strip() if m.start() <= at else heading
    parts = lambda x: [s.strip() for s in re.split(r"(?<=[.!?])\s+", x.strip()) if s.strip()]
    kept, used = parts(text[max(0, at - 300) : at]), 0
    used = sum(map(len, kept))
    for s in parts(text[at + len(chunk) : at + len(chunk) + 300]):
        if used + len(s) > 400:
            break
        kept.append(s)
        used += len(s)
    head = [f"Document: {title}"] + ([f"Section: {heading}"] if heading else []) + ([f"Context: {' '.join(kept)}"] if kept else [])
    return "\n".join(head) + f"\n\n{chunk}"


def test_context_around_chunks(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        paragraphs = [rng.choice(["# Top", "## Part two ", "plain words here. And more! ", "x" * 350 + ".", "Repeated line.", "short", "Ends? Yes.  Fine é😀."]) + (str(rng.randrange(3)) if rng.random() < 0.4 else "") for _ in range(rng.randint(1, 14))]
        text = rng.choice(["\n", "\n\n"]).join(paragraphs)
        rows.append((i, text, [p for p in paragraphs if p] + ["not in the text"]))
    df = spark.createDataFrame(rows + [(90, "", []), (91, "only", ["only"])], "doc_id int, text string, chunks array<string>")
    out = {(r.doc_id, r.position): r.chunk for r in chunking.with_context(df, F.concat(F.lit("d"), F.col("doc_id"))).collect()}
    for i, text, chunks in rows:
        for j, chunk in enumerate(chunks):
            assert out[i, j] == context_by_force(text, chunk, f"d{i}"), (text, chunk)
    assert out[91, 0] == "Document: d91\n\nonly" and (90, 0) not in out


@pytest.mark.parametrize("size", [5, 40, 500])
def test_mention_sketch_keeps_its_bounds(spark, monkeypatch, size):
    rng = random.Random(2)
    monkeypatch.setattr(sketches, "FAN", 3)
    items = [f"item{int(rng.paretovariate(0.8)) % 300}" for _ in range(8000)] + [f"rare{i}" for i in range(500)] + [None] * 9
    rng.shuffle(items)
    exact = Counter(i for i in items if i is not None)
    df = spark.createDataFrame([(i,) for i in items], "name string").repartition(11)
    rows = sketches.frequent(df, size).collect()
    assert len(rows) <= size and len({r.item for r in rows}) == len(rows)
    least = rows[0].least
    assert least <= exact.total() / size
    for r in rows:
        assert r.n - r.error <= exact[r.item] <= r.n, r
    held = {r.item for r in rows}
    assert all(n <= least for i, n in exact.items() if i not in held)
    assert {i for i, n in exact.items() if n > exact.total() / size} <= held
    assert sketches.frequent(df.limit(0), size).count() == 0


def test_mentions(spark):
    text = 'The (Engine) uses fuel-pump, and my_var; "Ok" xx- Été. école'
    got = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(sketches.mentions(F.col("t")).alias("m")).collect()
    assert list(got[0].m) == ["The", "Engine", "fuel-pump", "my_var", "xx-", "Été"] and got[1].m is None and list(got[2].m) == []


def test_seeded_split(spark):
    df = spark.createDataFrame([(i % 90_000, "x") for i in range(1003)] + [(None, "y")], "id long, part2 string")
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    a = {r.id: r.part for r in analytics.seeded_split(df.repartition(7), "id", shares).collect()}
    assert Counter(a.values()) == {"train": 803, "validation": 100, "test": 101}
    assert a == {r.id: r.part for r in analytics.seeded_split(df.repartition(2), "id", shares).collect()}
    b = {r.id: r.part for r in analytics.seeded_split(df, "id", shares, seed=7).collect()}
    assert b != a and Counter(b.values()) == Counter(a.values())
    same = analytics.seeded_split(spark.createDataFrame([(1,)] * 50, "id int"), "id", shares).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in same} == {"train": 40, "validation": 5, "test": 5}
    assert analytics.seeded_split(df.limit(0), "id", shares).count() == 0


def test_heading_tree_of_a_long_text(spark, monkeypatch):
    """20,000 headings take seconds, in batches of any size; equal ones have the children of the first, missing levels close all."""
    texts = [f"h{i % 9000}" for i in range(20_000)]
    rows = [(1, [(i % 5 + 1, x) for i, x in enumerate(texts)]), (2, None), (3, []), (4, [(2, "a"), (None, "b"), (3, "c"), (2, None), (3, "d"), (2, None), (2, "a")])]
    df = spark.createDataFrame(rows, "doc_id long, headings array<struct<level:int,text:string>>")
    began = time.time()
    got = {(r.doc_id, r.position): (r.level, r.heading, r.parent, r.children) for r in chunking.heading_tree(df).collect()}
    assert time.time() - began < 60
    assert len(got) == 20_007 and got[1, 19_999] == (5, "h1999", 19_998, []) and got[1, 9001] == (2, "h1", 9000, ["h2"])
    assert [got[4, i] for i in range(7)] == [(2, "a", -1, []), (None, "b", -1, []), (3, "c", -1, []), (2, None, -1, ["d"]), (3, "d", 3, []), (2, None, -1, ["d"]), (2, "a", -1, [])]
    monkeypatch.setattr(chunking, "OUT_BYTES", 1000)
    assert got == {(r.doc_id, r.position): (r.level, r.heading, r.parent, r.children) for r in chunking.heading_tree(df).collect()}
