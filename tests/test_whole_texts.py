"""Queries read whole texts: what stands far behind the start of a document counts."""

import random

import pytest

from loam.plans import registry
from loam.plans.chunk_queries import common_length


@pytest.fixture
def asked(spark, tmp_path):
    """Rows of a query over documents with the given texts, numbered from 0."""

    def run(name, *texts):
        rows = [(i, x, "en", "s", len(x)) for i, x in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet", mode="overwrite")
        return registry.QUERIES[name](spark, str(tmp_path)).collect()

    return run


def common_by_force(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_length():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 90))] for _ in "ab")
        assert common_length(a, b) == common_by_force(a, b)


def test_overlap_of_whole_texts(asked):
    a, b = "x " * 200 + "one two three four", "y " * 200 + "one three four"
    [row] = asked("EVA22_rouge_l", a, b)
    assert (row.precision, row.recall) == (round(3 / 204, 6), round(3 / 203, 6))
    [row] = asked("EVA33_self_critique", a, b)
    # words {x, one, two, three, four} and {y, one, three, four}: half cosine, half containment
    assert row.support == pytest.approx(0.5 * 3 / 20**0.5 + 0.5 * 3 / 5, abs=1e-6)


FAR = "word " * 200


def test_sections_behind_the_start(asked):
    text = FAR + "\n## Late\nlast words"
    # every line of a text is a heading of that query
    lines = [x for x in text.split("\n") if x.strip()]
    indexed = sorted(asked("CHK05_heading_index", text), key=lambda r: r.position)
    assert len(indexed) == len(lines) and all(x in r.chunk for x, r in zip(lines, indexed, strict=True))
    chunks = [r.chunk for r in sorted(asked("CHK07_enriched_chunks", text, text), key=lambda r: (r.doc_id, r.position))]
    of_last = [x for x in chunks if x.endswith("last words")]
    assert len(of_last) == 2 and all("\nSection: Late\n" in x for x in of_last)
    assert [r.title for r in asked("CHK10_chapters", FAR + "\nChapter 77\nmore")] == ["Chapter 0", "Chapter 77", "Section 2"]


def test_links_behind_the_start(asked):
    text = FAR + "[far](http://far)"
    assert [r.links for r in asked("FUN34_markdown_links", text)] == ["http://x/0 http://far"]
    [row] = asked("SRC11_markup_docs", text + "\n## Late")
    assert row.headings == 2 and row.links == "http://far b"


def test_questions_behind_the_start(asked):
    rows = asked("FUN61_questions", "", "a" * 150 + ". Где лежит ключ?")
    assert {r.doc_id: r.questions for r in rows}[1] == "Где лежит ключ?"


def test_chapters_of_odd_rows(spark, tmp_path):
    """A missing text has the two headings of every document, and so has one without a number or with a negative one."""
    rows = [(1, None), (-2, "a\rChapter 3"), (None, "b"), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = [tuple(r) for r in registry.QUERIES["CHK10_chapters"](spark, f"{tmp_path}/odd").collect()]
    wanted = [(i, title) for i, _ in rows for title in (None if i is None else f"Chapter {i}", "Section 2")]
    assert sorted(got, key=str) == sorted(wanted, key=str)
