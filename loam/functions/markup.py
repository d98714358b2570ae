"""Parts of marked-up text as columns: tables, headings, code blocks and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import matches, once

#: Most characters of a code block.
CODE = 2000


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def cell_text(html: Column) -> Column:
    """Text of a cell: tags dropped, four entities read, no white space at the ends."""
    t = F.regexp_replace(html, "<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return trimmed(t)


def html_tables(html: Column) -> Column:
    """array<struct<caption, headers, rows>> of a page's tables that hold cells; tables inside tables are not told apart.

    headers are the cells of the first row of a thead, or of the first row with
    a th; all rows but that one and those of a thead are data. A null page has
    no tables (null).
    """
    part = lambda body, tag: F.regexp_extract(body, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    line = lambda tr: F.struct(tr.rlike(r"(?i)<th\b").alias("head"), F.transform(matches(tr, r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>", 1), cell_text).alias("cells"))
    lines = lambda body: F.filter(F.transform(matches(body, r"(?is)<tr\b[^>]*>(.*?)</tr>", 1), line), lambda r: F.size(r["cells"]) > 0)
    none = F.array().cast("array<string>")

    def table(body: Column) -> Column:
        head, rest = lines(part(body, "thead")), lines(F.regexp_replace(body, r"(?is)<thead\b.*?</thead>", ""))
        both = F.struct(head.alias("head"), rest.alias("rest"))

        def split(x: Column) -> Column:
            at = F.when(F.size(x["head"]) > 0, F.lit(-1)).otherwise(F.array_position(F.transform(x["rest"], lambda r: r["head"]), True).cast("int") - 1)
            headers = F.when(F.size(x["head"]) > 0, x["head"][0]["cells"]).otherwise(once(at, lambda i: F.when(i >= 0, x["rest"][F.greatest(i, F.lit(0))]["cells"]).otherwise(none)))
            rows = F.transform(F.filter(x["rest"], lambda r, i: i != at), lambda r: r["cells"])
            return F.struct(cell_text(part(body, "caption")).alias("caption"), headers.alias("headers"), rows.alias("rows"))

        return once(both, split)

    found = F.transform(matches(html, r"(?is)<table\b[^>]*>(.*?)</table>", 1), table)
    return F.filter(found, lambda t: (F.size(t["headers"]) > 0) | (F.size(t["rows"]) > 0))


def table_markdown(table: Column) -> Column:
    """A table as Markdown, padded to its headers or its longest row; line breaks become spaces, bars are escaped."""
    clean = lambda x: F.replace(F.replace(x, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    longest = F.coalesce(F.array_max(F.transform(table["rows"], F.size)), F.lit(0))
    width = F.when(F.size(table["headers"]) > 0, F.size(table["headers"])).otherwise(longest)

    def of_width(n: Column) -> Column:
        padded = lambda cells: F.concat(F.transform(cells, clean), F.array_repeat(F.lit(""), F.greatest(F.lit(0), n - F.size(cells))))
        line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        head = F.when(F.size(table["headers"]) > 0, line(padded(table["headers"]))).otherwise(line(F.array_repeat(F.lit(" "), n)))
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), n), "|"), F.lit("|"))
        title = F.when(table["caption"] != "", F.array(F.concat(F.lit("**"), table["caption"], F.lit("**\n")))).otherwise(F.array().cast("array<string>"))
        return F.when(n == 0, "").otherwise(F.array_join(F.concat(title, F.array(head, rule), F.transform(table["rows"], lambda r: line(padded(r)))), "\n"))

    return once(width, of_width)


def table_records(table: Column) -> Column:
    """A table's rows as maps from header to cell; cells beyond the headers are left out, of equal headers the last counts."""

    def record(row: Column) -> Column:
        pairs = F.transform(F.slice(row, F.lit(1), F.size(table["headers"])), lambda x, i: F.struct(table["headers"][i].alias("k"), x.alias("v")))
        last = lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"]))
        return F.map_from_entries(once(pairs, last))

    return F.transform(table["rows"], record)


def markdown_headings(text: Column) -> Column:
    """array<struct<level, text>> of headings of one to six marks."""
    found = matches(text, r"(?m)^#{1,6}\s+.+$")
    return F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, "^(#+)", 1)).alias("level"), trimmed(F.regexp_replace(h, r"^#+\s+", "")).alias("text")))


def blocks(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(matches(text, pattern, 1), lambda x: F.substring(trimmed(x), 1, CODE)), lambda x: x != "")


def markdown_code(text: Column) -> Column:
    return blocks(text, r"(?s)```\w*\n(.*?)```")


def markdown_tables(text: Column) -> Column:
    """Runs of lines that begin with a bar and hold another, each trimmed."""
    runs = matches(text, r"(?m)(?:^[ \t]*\|[^\n]*\|[^\n]*(?:\n|\z))+")
    line = lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")
    return F.transform(runs, lambda r: F.array_join(F.transform(F.split(F.regexp_replace(r, r"\n\z", ""), "\n"), line), "\n"))


def markdown_links(text: Column) -> Column:
    """array<struct<text, url>> of links."""
    return F.transform(matches(text, r"\[[^\]]+\]\([^)]+\)"), lambda x: F.struct(F.regexp_extract(x, r"^\[([^\]]+)\]", 1).alias("text"), F.regexp_extract(x, r"\(([^)]+)\)$", 1).alias("url")))


def rst_code(text: Column) -> Column:
    return blocks(text, r"(?s)\.\.\s+code-block::[^\n]*\n\n(.*?)(?=\n\S|\z)")


def asciidoc_code(text: Column) -> Column:
    return blocks(text, r"(?s)----\n(.*?)----")
