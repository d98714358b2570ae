"""Splitting documents into chunks.

Splits that a pattern states are columns and explodes. Those that carry state
from one chunk to the next (packing, merging, overlap) run on Arrow batches, a
document at a time; a document never leaves its task.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T


def heading_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """Sections under headings of levels 1 to 3: position, level, heading, content.

    What stands before the first heading is left out; a text without headings is
    one section named root.
    """
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^#{1,3}\s+\S)"), lambda p: p.rlike(r"^#{1,3}\s+\S"))
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    made = F.transform(
        parts,
        lambda p: F.struct(
            F.length(F.regexp_extract(p, "^(#{1,3})", 1)).alias("level"),
            trim(F.regexp_extract(p, r"^#{1,3}\s+([^\n]+)", 1)).alias("heading"),
            trim(F.regexp_replace(p, r"^#{1,3}\s+[^\n]+", "")).alias("content"),
        ),
    )
    root = F.array(F.struct(F.lit(0).alias("level"), F.lit("root").alias("heading"), trim(F.col(text)).alias("content")))
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.when(F.size(parts) > 0, made).otherwise(root)).alias("position", "s")).select(*rest, "position", "s.*")


#: Bytes of headings and children in a batch that a Python worker gives back.
OUT_BYTES = 8_000_000


def heading_tree(df: DataFrame, headings: str = "headings") -> DataFrame:
    """One row per heading: position, level, heading, parent (position, -1 at the top) and children (their headings, in order).

    df has an array<struct<level:int,text:string>> in the order of the text; its
    other columns stay. A heading's parent is the nearest one before it of a
    lower level, found in one walk that holds the open levels; levels may be of
    any depth and skip some. Of headings equal in level and text, all have the
    children of the first. Time grows with the headings and the children listed.
    """
    rest = [c for c in df.columns if c != headings]
    kind = "array<struct<level:int,text:string>>"
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.transform(headings, lambda h: F.struct(h["level"].cast("int").alias("level"), h["text"].cast("string").alias("text"))), F.array().cast(kind)).alias(headings))
    schema = StructType([*(source.schema[c] for c in rest), *StructType.fromDDL("position int, level int, heading string, parent int, children array<string>").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(rest))
            level, text = lists.flatten().flatten()
            levels, chars = level.to_pylist(), pc.fill_null(pc.binary_length(text), 0).to_pylist()
            codes = text.dictionary_encode().indices.to_pylist()
            below: list[list[int]] = [[] for _ in levels]
            parents, firsts, places = [], [], []
            start = 0
            for n in lists.value_lengths().to_pylist():
                still: list[int] = []
                first: dict = {}
                for i in range(start, start + n):
                    own = levels[i]
                    while still and (own is None or levels[still[-1]] >= own):
                        still.pop()
                    parents.append(still[-1] - start if still else -1)
                    if still:
                        below[still[-1]].append(i)
                    if own is not None:
                        still.append(i)
                    firsts.append(first.setdefault((own, codes[i]), i))
                    places.append(i - start)
                start += n
            owner = pc.list_parent_indices(lists)
            sizes = [sum(chars[j] for j in x) for x in below]
            begin = size = 0
            for i, f in enumerate(firsts):
                size += chars[i] + sizes[f] + 8 * len(below[f]) + 64
                if size < OUT_BYTES and i + 1 < len(firsts):
                    continue
                kids = [below[j] for j in firsts[begin : i + 1]]
                offsets = pa.array([0, *accumulate(map(len, kids))], pa.int32())
                children = pa.ListArray.from_arrays(offsets, text.take(pa.array([j for x in kids for j in x], pa.int64())))
                span, of = slice(begin, i + 1), owner.slice(begin, i + 1 - begin)
                columns = [*(batch.column(j).take(of) for j in range(len(rest))), pa.array(places[span], pa.int32()), level.slice(begin, len(of)), text.slice(begin, len(of)), pa.array(parents[span], pa.int32()), children]
                yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(columns, arrow, strict=True)], schema=arrow)
                begin, size = i + 1, 0

    return source.mapInArrow(run, schema)


def heading_chunks(df: DataFrame, title: Column, headings: str = "headings") -> DataFrame:
    """heading_tree with chunk: the title, the heading with its marks and the names of the sections below it."""
    tree = heading_tree(df.withColumn("_title", title), headings)
    parts = F.concat_ws(
        "\n",
        F.when(F.coalesce("_title", F.lit("")) != "", F.concat(F.lit("Document: "), F.col("_title"))),
        F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("heading")),
        F.when(F.size("children") > 0, F.concat(F.lit("Sections: "), F.array_join("children", ", "))),
    )
    return tree.withColumn("chunk", parts).drop("_title")


#: Characters around a chunk from which its context is taken, and most characters of the context.
AROUND, CONTEXT = 300, 400


def with_context(df: DataFrame, title: Column, text: str = "text", chunks: str = "chunks") -> DataFrame:
    """One row per chunk of each row: position and chunk, behind its document's title, its heading and the sentences around it.

    df has a text and an array of its chunks; other columns stay. A chunk stands
    where its text begins first. Its heading is the last one (levels 1 to 3) that
    begins there or before; the sentences are those of AROUND characters before
    and after, as many as keep within CONTEXT. A chunk that is not in the text,
    or that gets no context, has what there is. The text stays in its row: only
    the chunks are rows of their own.
    """
    rest = [c for c in df.columns if c not in (text, chunks)]
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    body = F.col(text)

    def around(chunk: Column, at: Column) -> Column:
        split = lambda x: F.filter(F.transform(F.split(trim(x), r"(?<=[.!?])\s+"), trim), lambda s: s != "")
        first = F.greatest(F.lit(1), at - AROUND)
        chars = lambda n, s: n + F.length(s)

        def fitting(before: Column) -> Column:
            def take(state: Column, s: Column) -> Column:
                used = state["used"] + F.length(s)
                return F.struct(used.alias("used"), F.when(used <= CONTEXT, F.concat(state["kept"], F.array(s))).otherwise(state["kept"]).alias("kept"))

            start = F.struct(F.aggregate(before, F.lit(0), chars).alias("used"), before.alias("kept"))
            return F.aggregate(split(F.substring(body, at + F.length(chunk), F.lit(AROUND))), start, take, lambda state: F.array_join(state["kept"], " "))

        return T.once(split(F.substring(body, first, at - first)), fitting)

    def section(at: Column) -> Column:
        line_end = F.locate("\n", F.substring(body, at, F.length(body))) + at - 1
        upto = F.substring(body, F.lit(1), F.when(line_end < at, F.length(body)).otherwise(line_end))
        return trim(F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(upto, F.lit(r"(?m)^#{1,3}[ \t]+(\S[^\n]*)$"), F.lit(1))), -1))

    def enriched(chunk: Column) -> Column:
        some = lambda name, value: F.transform(F.filter(F.array(value), lambda v: v != ""), lambda v: F.concat(F.lit(f"{name}: "), v))
        of_text = lambda at: F.concat(some("Section", section(at)), some("Context", around(chunk, at)))
        found = T.once(F.position(chunk, body), lambda at: F.when(at > 0, of_text(at)).otherwise(F.array().cast("array<string>")))
        head = F.concat(some("Document", F.coalesce(title, F.lit(""))), found)
        return T.once(F.array_join(head, "\n"), lambda h: F.when(h == "", chunk).otherwise(F.concat(h, F.lit("\n\n"), chunk)))

    return df.select(*rest, F.posexplode(F.transform(chunks, enriched)).alias("position", "chunk"))


#: Lines that begin a chapter or section.
CHAPTER = r"(?:Chapter|CHAPTER|Глава|ГЛАВА)\s+\d+|(?:Section|SECTION|Раздел)\s+\d+|\d+\.\s+\w|(?:Part|PART|Часть)\s+\d+|[IVXLC]+\.\s+\w"


def chapters(text: Column) -> Column:
    """array<struct<title, content>>; a text without chapters is one without title. Lines end at \\n alone."""
    parts = F.filter(F.split(text, f"(?md)(?=^(?:{CHAPTER}))"), lambda p: p.rlike(f"^(?:{CHAPTER})"))
    made = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, f"^(?:{CHAPTER})", 0)).alias("title"), F.trim(p).alias("content")))
    return F.when(F.size(parts) > 0, made).otherwise(F.array(F.struct(F.lit("").alias("title"), text.alias("content"))))


CYRILLIC, LATIN, CJK = (re.compile(p) for p in ("[\u0400-\u052f]+", "[A-Za-z\u00c0-\u024f]+", "[\u4e00-\u9fff\u3040-\u30ff\uac00-\ud7af]+"))


def script_counts(text: str) -> tuple[int, int, int, int]:
    """Cyrillic, Latin, CJK and other characters; counts of joined texts add up."""
    of = lambda p: sum(map(len, p.findall(text)))
    a, b, c = (0, of(LATIN), 0) if text.isascii() else (of(CYRILLIC), of(LATIN), of(CJK))
    return a, b, c, len(text) - a - b - c


def tokens_of(counts: tuple[int, int, int, int]) -> int:
    a, b, c, rest = counts
    return max(1, math.floor(a / 3.0 + b / 4.0 + c / 1.5 + rest / 4.0)) if any(counts) else 0


def tokens(text: str) -> int:
    """Token estimate by script, as functions.text.script_tokens."""
    return tokens_of(script_counts(text))


def added(*counts: tuple[int, int, int, int], breaks: int = 0) -> tuple[int, int, int, int]:
    """Counts of texts joined, with breaks further characters between them."""
    a, b, c, rest = map(sum, zip(*counts, strict=True))
    return a, b, c, rest + breaks


def per_document(df: DataFrame, key: str, text: str, fn: Callable[[str], list[tuple]], outputs: str) -> DataFrame:
    """Rows that fn makes of each text, with the key before them; null reads as empty."""
    source = df.select(key, text)
    schema = StructType([source.schema[key], *StructType.fromDDL(outputs).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in fn(t or "")]
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, schema)


def packed_paragraphs(text: str, most: int, split: str = r"\n\s*\n", prefix: str = "") -> list[str]:
    """Paragraphs joined while the estimate stays within most; a larger one stays whole.

    prefix, a heading, begins every chunk, and is one of its own where the first
    paragraph does not fit behind it. Each paragraph is estimated once.
    """
    out: list[str] = []
    head = script_counts(prefix)
    held, size = ([prefix], head) if prefix else ([], head)
    for part in filter(None, map(str.strip, re.split(split, text))):
        own = script_counts(part)
        if held and tokens_of(added(size, own, breaks=2)) > most:
            out.append("\n\n".join(held))
            held, size = [prefix + part], added(head, own)
        elif held:
            held.append(part)
            size = added(size, own, breaks=2)
        else:
            held, size = [part], own
    last = "\n\n".join(held)
    return out + [last] if last.strip() else out


def overlapped(chunks: list[str], chars: int) -> list[str]:
    """Each chunk behind the end of the one before it, which already has its own such beginning."""
    out: list[str] = []
    for chunk in chunks:
        out.append(f"[previous context: ...{out[-1][-chars:]}]\n\n{chunk}" if out and out[-1] else chunk)
    return out


def merged_short(chunks: list[str], least: int, most: int) -> list[str]:
    """Neighbours joined where one is below least and both together are within most."""
    out: list[list[str]] = []
    size = (0, 0, 0, 0)
    for chunk in chunks:
        own = script_counts(chunk)
        if out and tokens_of(size) + tokens_of(own) <= most and min(tokens_of(size), tokens_of(own)) < least:
            out[-1].append(chunk)
            size = added(size, own, breaks=2)
        else:
            out.append([chunk])
            size = own
    return ["\n\n".join(x) for x in out]


HEADING = re.compile(r"^(#{1,3})\s+([^\n]+)", re.M)


def markdown_sections(text: str) -> list[tuple[str, str]]:
    """(heading line, content) of sections under headings of levels 1 to 3; a text without headings has no heading line."""
    found = list(HEADING.finditer(text))
    if not found:
        return [("", text.strip())]
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [(f"{m.group(1)} {m.group(2).strip()}\n", text[m.end() : end].strip()) for m, end in zip(found, ends, strict=True)]


def pack_parts(sections: list[tuple[str, str]], most: int, least: int, overlap: int, split: str) -> list[tuple]:
    parts = [x for head, body in sections for x in packed_paragraphs(body, most, split, head)]
    parts = merged_short(overlapped(parts, 4 * overlap) if overlap else parts, least, most)
    return [(i, x, tokens(x)) for i, x in enumerate(parts)]


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1500, least: int = 100, overlap: int = 0, split: str = r"\n\s*\n") -> DataFrame:
    """key, position, chunk, tokens: packed paragraphs, overlapped and then merged where short."""
    return per_document(df, key, text, lambda t: pack_parts([("", t)], most, least, overlap, split), "position int, chunk string, tokens int")


def pack_markdown(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1500, least: int = 100, overlap: int = 0, split: str = r"\n\s*\n") -> DataFrame:
    """As pack, section by section; every chunk of a section begins with its heading line."""
    return per_document(df, key, text, lambda t: pack_parts(markdown_sections(t), most, least, overlap, split), "position int, chunk string, tokens int")


def overlap(df: DataFrame, chars: int, key: str = "doc_id", chunks: str = "chunks") -> DataFrame:
    """key, position, chunk of an array of a document's chunks, each behind the end of the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, x) for k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, x in enumerate(overlapped([y or "" for y in own or []], chars))]
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow)

    source = df.select(key, chunks)
    schema = StructType([source.schema[key], *StructType.fromDDL("position int, chunk string").fields])
    arrow = to_arrow_schema(schema)
    return source.mapInArrow(run, schema)


def elements(text: str) -> list[tuple[str, str]]:
    """(kind, text) of headers, fenced code, tables and single lines."""
    found, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        line = lines[i]
        stop = i + 1
        if re.match(r"#{1,6}\s+", line):
            kind = "header"
        elif line.strip().startswith("```"):
            kind = "code"
            while stop < len(lines) and not lines[stop].strip().startswith("```"):
                stop += 1
            stop = min(stop + 1, len(lines))
        elif "|" in line and i + 1 < len(lines) and "---" in lines[i + 1]:
            kind = "table"
            while stop < len(lines) and "|" in lines[stop]:
                stop += 1
        else:
            kind = "paragraph" if line.strip() else ""
        if kind:
            found.append((kind, "\n".join(lines[i:stop])))
        i = stop
    return found


def adaptive(text: str, target: int = 800, least: int = 200, most: int = 2000, overlap: float = 0.15) -> list[tuple[str, str]]:
    """(kind, text): elements merged up to target, long ones split at sentences, with overlap.

    An element shorter than least that a header, code or an overflow follows is
    dropped, the last one never.
    """
    merged: list[tuple[str, str]] = []
    held: tuple[str, str] | None = None
    for kind, body in elements(text):
        if held and kind not in ("header", "code") and held[0] != "code" and len(held[1]) + len(body) <= target:
            held = (held[0], f"{held[1]}\n{body}")
            continue
        if held and len(held[1]) >= least:
            merged.append(held)
        held = (kind, body)
    if held:
        merged.append(held)
    pieces: list[tuple[str, str]] = []
    for kind, body in merged:
        if len(body) <= most:
            pieces.append((kind, body))
            continue
        run = ""
        for sentence in re.split(r"(?<=[.!?])\s+", body):
            if len(run) + len(sentence) > target:
                if run:
                    pieces.append((kind, run.strip()))
                run = sentence
            else:
                run = f"{run} {sentence}" if run else sentence
        if run:
            pieces.append((kind, run.strip()))
    out: list[tuple[str, str]] = []
    for kind, body in pieces:
        if out and overlap > 0:
            n = int(len(out[-1][1]) * overlap)
            body = f"[previous context: ...{out[-1][1][-n:] if n else out[-1][1]}]\n\n{body}"
        out.append((kind, body))
    return out


def adaptive_chunks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return per_document(df, key, text, lambda t: [(i, k, b) for i, (k, b) in enumerate(adaptive(t))], "position int, kind string, chunk string")


BRACED = re.compile(r"^[ \t]*(?:(?:public|private|protected|static|export|async|final|abstract)\s+)*(?:class|interface|function|enum)\s+(\w+)", re.M)


def code_units(source: str, language: str) -> list[tuple[str, str, str]]:
    """(kind, name, text) of top-level definitions: by syntax tree for Python, by declaration lines elsewhere.

    Source that does not parse, or has no definition, is one unit of kind module.
    """
    units: list[tuple[str, str, str]] = []
    if language == "python":
        try:
            lines = source.split("\n")
            for node in ast.parse(source).body:
                if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                    units.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, "\n".join(lines[first - 1 : node.end_lineno])))
        except (SyntaxError, ValueError):
            units = []
    else:
        starts = list(BRACED.finditer(source))
        for i, m in enumerate(starts):
            stop = starts[i + 1].start() if i + 1 < len(starts) else len(source)
            units.append(("class" if "class" in m.group(0) else "function", m.group(1), source[m.start() : stop].rstrip()))
    return units or [("module", "", source)]


def code_chunks(df: DataFrame, language: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    return per_document(df, key, text, lambda t: code_units(t, language), "kind string, name string, chunk string")


def raptor(df: DataFrame, fan: int = 5, most: int = 2000, levels: int = 10, summary: Callable[[Column], Column] | None = None) -> DataFrame:
    """A tree over (doc_id, pos, text): level, node, parent, text.

    Each level joins fan neighbours (with summary, that of their joined texts),
    cut at most characters, until every document has one node. The loop runs once a level, on the driver only as a plan.
    """
    level = df.select("doc_id", F.col("pos").cast("long").alias("node"), "text")
    out = None
    for depth in range(levels + 1):
        rows = level.select("doc_id", F.lit(depth).alias("level"), "node", F.floor(F.col("node") / fan).alias("parent"), "text")
        out = rows if out is None else out.unionByName(rows)
        grown = level.groupBy("doc_id", F.floor(F.col("node") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("node", "text"))).alias("x"))
        many = level.groupBy("doc_id").agg(F.max("node").alias("last")).where("last > 0").select("doc_id")
        joined = F.array_join(F.transform("x", lambda s: s["text"]), " ")
        level = grown.join(many, "doc_id", "left_semi").select("doc_id", F.col("up").alias("node"), F.substring(summary(joined) if summary else joined, 1, most).alias("text"))
    return out
