"""Books: EPUB and DOCX files (zip archives of markup) to chapter documents. PDF needs a parser that Spark lacks."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

DOCX_TEXT = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def markup_text(markup: str) -> str:
    markup = re.sub(r"(?is)<(script|style|head)[^>]*>.*?</\1>", "", markup)
    markup = re.sub(r"(?i)</(p|div|h[1-6]|li|tr)>|<br\s*/?>", "\n", markup)
    lines = (x.strip() for x in html.unescape(re.sub(r"<[^>]+>", "", markup)).split("\n"))
    return "\n".join(filter(None, lines))


def epub(raw: bytes) -> list[tuple[str, str]]:
    """(title, text) of each spine item, in reading order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        path = next(e.attrib["full-path"] for e in box.iter() if e.tag.endswith("rootfile"))
        package = ElementTree.fromstring(z.read(path))
        items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item")}
        out = []
        for ref in (e for e in package.iter() if e.tag.endswith("}itemref")):
            page = z.read(posixpath.join(posixpath.dirname(path), items[ref.attrib["idref"]])).decode("utf-8", "replace")
            title = re.search(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", page)
            if text := markup_text(page):
                out.append((markup_text(title.group(1)) if title else "", text))
    return out


def docx(raw: bytes) -> list[tuple[str, str]]:
    """(title, text) between paragraphs styled as headings."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    chapters: list[tuple[str, list[str]]] = []
    for p in root.iter(DOCX_TEXT + "p"):
        text = "".join(t.text or "" for t in p.iter(DOCX_TEXT + "t")).strip()
        style = p.find(f"{DOCX_TEXT}pPr/{DOCX_TEXT}pStyle")
        if style is not None and style.attrib.get(DOCX_TEXT + "val", "").lower().startswith("heading"):
            chapters.append((text, []))
        elif text:
            if not chapters:
                chapters.append(("", []))
            chapters[-1][1].append(text)
    return [(title, "\n".join(lines)) for title, lines in chapters]


def chapters(files: DataFrame) -> DataFrame:
    """path, position, title, content of binaryFile rows; a file that can't be read gives one row without content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = (epub if path.lower().endswith(".epub") else docx)(raw)
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError):
                    found = [("", None)]
                rows += [(path, i, title, text) for i, (title, text) in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=["path", "position", "title", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, position int, title string, content string")
