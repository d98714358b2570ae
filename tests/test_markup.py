"""Tables, headings, code and links of marked-up text: golden values."""

from pyspark.sql import functions as F

from loam.functions import markup as K

HTML = """<p>x</p><TABLE class="a"><caption> Two <b>engines</b></caption><thead><tr><th>Name</th><th>Power &amp; fuel</th></tr></thead>
<tbody><tr><td>A|1</td><td>10
kW</td></tr><tr><td>B</td></tr><tr></tr></tbody></TABLE>
<table><tr><td>first</td></tr><tr><th>k</th><th>k</th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table><table></table><table><tr><td>a</td><td>b</td></tr></table>"""
MARKDOWN = "# One\ntext [a b](http://x/1) and [c](y)\n\n| h | i |\n|---|---|\n| 1 | 2 |\nafter\n  | only | one |\n### Three  \n```python\ncode()\n```\n```\n\n```\n#no heading\n"


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_tables(spark):
    made = K.html_tables(F.col("t"))
    row = one(spark, HTML, made.alias("x"), F.transform(made, K.table_markdown).alias("m"), F.transform(made, K.table_records).alias("r"))
    assert [(t.caption, list(t.headers), [list(r) for r in t.rows]) for t in row.x] == [
        ("Two engines", ["Name", "Power & fuel"], [["A|1", "10\nkW"], ["B"]]),
        ("", ["k", "k"], [["first"], ["1", "2", "3"]]),
        ("", [], [["a", "b"]]),
    ]
    assert row.m[0] == "**Two engines**\n\n| Name | Power & fuel |\n| --- | --- |\n| A\\|1 | 10 kW |\n| B |  |"
    assert row.m[2] == "|   |   |\n| --- | --- |\n| a | b |"
    assert row.r[0] == [{"Name": "A|1", "Power & fuel": "10\nkW"}, {"Name": "B"}] and row.r[1] == [{"k": "first"}, {"k": "2"}]
    assert one(spark, "no table", made.alias("x")).x == [] and one(spark, None, made.alias("x")).x is None


def test_markdown(spark):
    t = F.col("t")
    row = one(spark, MARKDOWN, K.markdown_headings(t).alias("h"), K.markdown_code(t).alias("c"), K.markdown_tables(t).alias("t"), K.markdown_links(t).alias("l"))
    assert [tuple(h) for h in row.h] == [(1, "One"), (3, "Three")] and row.c == ["code()"]
    assert row.t == ["| h | i |\n|---|---|\n| 1 | 2 |", "| only | one |"]
    assert [tuple(x) for x in row.l] == [("a b", "http://x/1"), ("c", "y")]


def test_other_code(spark):
    rst = "Title\n=====\n\n.. code-block:: python\n\n    a = 1\n\n    b = 2\nplain\n.. code-block::\n\n    last"
    assert one(spark, rst, K.rst_code(F.col("t")).alias("c")).c == ["a = 1\n\n    b = 2", "last"]
    assert one(spark, "x\n----\none\n----\ny\n----\n\n----\n", K.asciidoc_code(F.col("t")).alias("c")).c == ["one"]
    assert one(spark, "----\n" + "z" * 3000 + "\n----\n", K.asciidoc_code(F.col("t")).alias("c")).c == ["z" * 2000]
