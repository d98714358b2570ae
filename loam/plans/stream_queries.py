"""Queries of streams and plug-ins (STR, INC05, SRC12, SRC28, UDF rows).

A stream reads files written from a driver table, runs until nothing is left,
and writes each micro-batch to a folder of its own, which is read back.
"""

from __future__ import annotations

import html
import io
import json
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import plugins
from ..functions import text as T
from ..operators import chunking
from ..operators import ranking as R
from ..operators import versioning as V
from ..sources import books, readers
from ..streaming import pipelines as P
from ..streaming.etl import DocumentFlow
from ..streaming.models import transitions
from .registry import Tables, query
from .search_queries import dense
from .source_queries import changes, folder, pages, requests, tickets

c = F.col


def arrived(t: Tables, df: DataFrame, kind: str = "parquet", most: int = 4) -> DataFrame:
    """df as a stream of files."""
    path = folder(t, "arrived")
    df.write.format(kind).save(path)
    return P.read_files(t.spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), kind, most)


def drained(t: Tables, stream: DataFrame, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """What a stream has written once all its input is handled."""
    out = folder(t, "out")
    q = P.run_batches(stream, P.batch_sink(out, transform), folder(t, "state"))
    q.awaitTermination()
    return t.spark.read.parquet(out)


def produced(t: Tables) -> DataFrame:
    kinds = F.element_at(F.array(F.lit("jira"), F.lit("gitlab"), F.lit("mail")), (c("event_id") % 3 + 1).cast("int"))
    body = F.to_json(F.struct(kinds.alias("source"), c("event_type"), c("event_id").cast("string").alias("doc_id"), c("ts").cast("string").alias("timestamp"), c("props").alias("payload")))
    return t.events.select(F.when(c("event_id") % 100 == 7, F.lit("{broken")).otherwise(body).alias("value"))


query("STR01_event_producer", "SELECT count(*) AS n FROM events")(lambda t: drained(t, arrived(t, produced(t), "text")).groupBy().agg(F.count("*").alias("n")))
KEY = b"secret"
BODY = """CASE WHEN event_id % 13 = 5 THEN '{broken' WHEN event_id % 2 = 0 THEN '{"event": "' || event_type || '", "page": {"id": ' || event_id || '}}' ELSE '{"object_kind": "' || event_type || '"}' END"""
PAD = {x: bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)}
HMAC_SQL = f"sha256(unhex('{PAD[0x5C]}') || unhex(sha256(unhex('{PAD[0x36]}') || encode(body))))"


def hooks(t: Tables) -> DataFrame:
    """Requests of two sources: most are signed, some with another body's signature, some not at all."""
    d = t.events.select("event_id", F.when(c("event_id") % 2 == 0, "confluence").otherwise("gitlab").alias("source"), F.expr(BODY).alias("body"))
    sign = lambda x: F.concat(F.lit("sha256="), P.hmac_hex(x, KEY))
    return d.withColumn("signature", F.when(c("event_id") % 10 == 3, sign(F.concat("body", F.lit(" ")))).when(c("event_id") % 10 != 7, sign(c("body"))))


query(
    "STR02_webhook_signatures",
    f"""WITH b AS (SELECT event_id, event_type AS kind, {BODY} AS body FROM events), s AS (SELECT *, {HMAC_SQL} AS computed, CASE WHEN event_id % 10 IN (3, 7) THEN 401 WHEN event_id % 13 = 5 THEN 422 ELSE 202 END AS status FROM b)
    SELECT event_id, computed, status, CASE WHEN status = 202 THEN kind END AS event_type, CASE WHEN status = 202 THEN CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR ELSE kind END END AS doc_id FROM s""",
)(lambda t: P.received(hooks(t), KEY).select("event_id", "computed", "status", "event_type", "doc_id"))
query("STR03_consumed_batches", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")(lambda t: drained(t, arrived(t, t.events.repartition(6))).groupBy("event_type").agg(F.count("*").alias("n")))
query("STR04_redelivered", "SELECT event_id FROM events")(lambda t: drained(t, P.once(arrived(t, t.events.union(t.events.where("event_id % 10 = 0")), most=100), late="60 days")).select("event_id"))
query("STR05_stream_routing", "SELECT CASE WHEN event_id % 100 = 7 THEN 'rejected' WHEN event_id % 3 = 2 THEN 'other' WHEN event_id % 3 = 0 THEN 'jira' ELSE 'gitlab' END AS route, count(*) AS n FROM events GROUP BY 1")(
    lambda t: drained(t, arrived(t, produced(t), "text"), P.routed).groupBy("route").agg(F.count("*").alias("n"))
)


@query("STR06_lifecycle", "SELECT 2::BIGINT AS batches, count(*) AS rows FROM events")
def lifecycle(t: Tables) -> DataFrame:
    """Batches with rows, and rows, of a finished stream of four files, two a batch, from its own progress reports."""
    q = P.run_batches(arrived(t, t.events.repartition(4), most=2), P.batch_sink(folder(t, "out")), folder(t, "state"))
    q.awaitTermination()
    rows = [(int(p["batchId"]), int(p["numInputRows"])) for p in q.recentProgress]
    return t.spark.createDataFrame(rows, "batch long, rows long").where("rows > 0").agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"))


query("STR07_document_stream")(lambda t: drained(t, arrived(t, t.documents.select("doc_id", "text").repartition(4)), lambda df: chunking.pack(df, most=300, least=40, split=r"\n").withColumn("reason", T.boilerplate_reason(c("chunk"))).where("reason = ''")))


@query(
    "STR07_document_flow",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk FROM documents), k AS (SELECT * FROM l WHERE length(chunk) >= 20),
    n AS (SELECT doc_id, count(*) AS chunks, sum(length(chunk)) AS size FROM k GROUP BY 1),
    w AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(regexp_split_to_array(chunk, '\s+')), '^[.,;:!?()\[\]{}''"]+', ''), '[.,;:!?()\[\]{}''"]+$', '') AS name FROM k),
    e AS (SELECT doc_id, count(DISTINCT name) AS names FROM w WHERE length(name) > 2 AND regexp_matches(name, '^\p{Lu}|[_-]') GROUP BY 1)
    SELECT d.doc_id, coalesce(chunks, 0) AS chunks, coalesce(names, 0) AS names, coalesce(size, 0)::BIGINT AS size FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN n USING (doc_id) LEFT JOIN e USING (doc_id)""",
)
def document_flow(t: Tables) -> DataFrame:
    """All documents as a stream, chunked by line into chunk, graph, vector and status tables; counts from those tables."""
    lines = lambda df: df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "chunk"))
    flow = DocumentFlow(folder(t, "flow"), lines, lambda x: F.length(x) >= 20, lambda x: F.array(F.length(x).cast("float")))
    flow.run(arrived(t, t.documents.select("doc_id", "text").repartition(4)), folder(t, "state")).awaitTermination()
    names = flow.read(t.spark, "edges").groupBy("doc_id").agg(F.count("*").alias("names"))
    size = flow.read(t.spark, "vectors").groupBy("doc_id").agg(F.sum(F.col("vector")[0]).cast("long").alias("size"))
    out = flow.read(t.spark, "status").drop("batch").join(names, "doc_id", "left").join(size, "doc_id", "left")
    return out.select("doc_id", "chunks", F.coalesce("names", F.lit(0)).alias("names"), F.coalesce("size", F.lit(0)).alias("size"))


@query("FUN62_model_states")
def model_states(t: Tables) -> DataFrame:
    """Events as the life of fifty models: sign-ups set splits, views and clicks are good answers, errors bad ones, some purchases promote or roll back."""
    kind = F.when(c("event_type") == "signup", "split").when(c("event_type") == "error", F.when(c("event_id") % 8 == 0, "fail").otherwise("ok")).when(c("event_type") == "purchase", F.when(c("event_id") % 3 == 0, "promote").when(c("event_id") % 3 == 1, "rollback").otherwise("ok")).otherwise("ok")
    split = c("event_type") == "signup"
    events = t.events.select(
        F.concat(F.lit("model-"), c("user_id") % 50).alias("model"), (F.unix_micros(c("ts").cast("timestamp")) / 1e6).alias("ts"), kind.alias("kind"),
        F.when(split, c("event_id") % 90 / 100).alias("percent"), F.when(split, F.concat(F.lit("v"), c("event_id"))).alias("version"),
    )
    return transitions(events)


@query("STR09_rate_limit")
def rate_limit(t: Tables) -> DataFrame:
    stream = arrived(t, t.events.select("user_id", (F.unix_micros(c("ts").cast("timestamp")) / 1e6).alias("t")).coalesce(1))
    out = folder(t, "out")
    limited = P.token_bucket(stream, rate=1 / 3600, capacity=5)
    q = limited.writeStream.outputMode("update").foreachBatch(P.batch_sink(out)).option("checkpointLocation", folder(t, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(out)


query("STR13_retention", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")(
    lambda t: drained(t, arrived(t, t.events), lambda df: df.where(c("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count("*").alias("n"))
)
query("AGG01_streamed_usage", "SELECT ts::DATE::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")(
    lambda t: P.usage_by_window(t.events, late="60 days").select(c("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")
)


@query("INC05_checkpoints", "SELECT event_type AS pipeline, max(event_id) AS last_id, max(ts)::VARCHAR AS last_run, count(*) AS \"offset\" FROM events GROUP BY 1")
def resumed(t: Tables) -> DataFrame:
    """Two runs over the events, one pipeline a type: the second takes up where the stored state of the first ends."""
    path = folder(t, "checkpoints")
    e = t.events.withColumn("pipeline", c("event_type"))
    half = e.agg((F.max("event_id") / 2).cast("long").alias("half"))
    arrived_first = e.join(F.broadcast(half), c("event_id") <= c("half")).drop("half")
    state = t.spark.createDataFrame([], "pipeline string, key string, value string")
    for run, rows in enumerate((arrived_first, e)):
        before = state.where("key = 'offset'").select("pipeline", c("value").cast("long").alias("before"))
        done = V.since_checkpoint(rows, state, "pipeline", "event_id").groupBy("pipeline").agg(F.max("event_id").alias("last_id"), F.max("ts").cast("string").alias("last_run"), F.count("*").alias("n"))
        done = done.join(before, "pipeline", "left").withColumn("offset", c("n") + F.coalesce("before", F.lit(0)))
        keys = [F.struct(F.lit(k).alias("key"), c(k).cast("string").alias("value")) for k in ("last_id", "last_run", "offset")]
        V.save_checkpoints(done.select("pipeline", F.explode(F.array(*keys)).alias("x")).select("pipeline", "x.*"), path, run)
        state = V.checkpoints(t.spark, path)
    of = lambda k: F.max(F.when(c("key") == k, c("value")))
    return state.groupBy("pipeline").agg(of("last_id").cast("long").alias("last_id"), of("last_run").alias("last_run"), of("offset").cast("long").alias("offset"))


@query("SRC28_streamed_families", "SELECT 'confluence' AS source_type, count(*) AS n FROM pages UNION ALL SELECT 'jira', count(*) FROM orders UNION ALL SELECT 'gitlab_commit', count(*) FROM part UNION ALL SELECT 'gitlab_mr', count(*) FROM supplier")
def streamed_families(t: Tables) -> DataFrame:
    out = None
    for name, made in (("confluence", pages), ("jira", tickets), ("commits", changes), ("merge_requests", requests)):
        docs = drained(t, arrived(t, made(t).withColumnRenamed("raw", "value"), "text").withColumnRenamed("value", "raw"), readers.FAMILIES[name])
        out = docs if out is None else out.unionByName(docs)
    return out.groupBy("source_type").agg(F.count("*").alias("n"))


def tiny_epub(title: str, text: str) -> bytes:
    """An EPUB of one chapter."""
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="urn:c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
        z.writestr("o/p.opf", '<p xmlns="urn:p"><manifest><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/></spine></p>')
        z.writestr("o/a.xhtml", f"<html><body><h1>{title}</h1><p>{html.escape(text)}</p></body></html>")
    return box.getvalue()


def tiny_docx(title: str, text: str) -> bytes:
    """A DOCX of a heading and a paragraph for each line."""
    box = io.BytesIO()
    lines = "".join(f"<w:p><w:r><w:t>{html.escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
    head = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{title}</w:t></w:r></w:p>'
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{books.DOCX_TEXT[1:-1]}"><w:body>{head}{lines}</w:body></w:document>')
    return box.getvalue()


def bound(t: Tables) -> DataFrame:
    """path and content: every document as a book, an EPUB or a DOCX file."""

    def run(frames):
        for f in frames:
            made = [(f"{i}.epub", tiny_epub(f"Doc {i}", x)) if i % 2 == 0 else (f"{i}.docx", tiny_docx(f"Doc {i}", x)) for i, x in zip(f["doc_id"], f["text"], strict=True)]
            yield pd.DataFrame(made, columns=["path", "content"])

    return t.documents.select("doc_id", "text").mapInPandas(run, "path string, content binary")


query(
    "SRC12_books",
    """WITH l AS (SELECT doc_id, 'Doc ' || doc_id AS title, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS body FROM documents)
    SELECT doc_id || CASE WHEN doc_id % 2 = 0 THEN '.epub' ELSE '.docx' END AS path, title, sha256(CASE WHEN doc_id % 2 = 0 THEN title || chr(10) || body ELSE body END) AS content FROM l""",
)(lambda t: books.chapters(bound(t)).select("path", "title", F.sha2("content", 256).alias("content")))


def word_share(query: str, text: str, least: float = 0.0) -> float:
    """Share of a query's words that a text has."""
    own = set(query.split())
    share = len(own & set(text.split())) / max(1, len(own))
    return share if share >= least else 0.0


@query("UDF01_tool_schemas")
def tool_schemas(t: Tables) -> DataFrame:
    plugins.tool(word_share)
    return t.spark.createDataFrame([(s["name"], json.dumps(s["parameters"], sort_keys=True)) for s in plugins.tools()], "name string, parameters string")


@query("UDF03_registered_function", "SELECT item_id, length(text)::BIGINT AS n FROM benchmark")
def registered(t: Tables) -> DataFrame:
    plugins.register_sql(t.spark, "text_length", lambda s: s.str.len(), "long")
    return t.benchmark.selectExpr("item_id", "text_length(text) AS n")


LEVELS = "WITH l AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents) GROUP BY 1), k AS (SELECT n AS a, ceil(n / 5.0) AS b, ceil(ceil(n / 5.0) / 5.0) AS c, ceil(ceil(ceil(n / 5.0) / 5.0) / 5.0) AS d FROM l)"
query(
    "UDF04_plugged_summary",
    f"""{LEVELS} SELECT * FROM (SELECT 0 AS level, sum(a)::BIGINT AS n FROM k UNION ALL SELECT 1, sum(b)::BIGINT FROM k WHERE a > 1 UNION ALL SELECT 2, sum(c)::BIGINT FROM k WHERE b > 1 UNION ALL SELECT 3, sum(d)::BIGINT FROM k WHERE c > 1) WHERE n > 0""",
)(lambda t: chunking.raptor(t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")), levels=3, summary=T.two_sentences).groupBy("level").agg(F.count("*").alias("n")))
query("UDF05_plugged_search")(lambda t: plugins.chained(lambda q: dense(t, 20), lambda hits: R.knee(hits))(t.embeddings).select("query_id", "doc_id", "score"))
IMAGES = "html || repeat('<img src=\"/a.png\" alt=\"a plain caption of it\">', (page_id % 4)::INT) || repeat('<img src=\"/b.png\" alt=\"\">', (page_id % 3)::INT)"
query("SRC32_image_records", "SELECT page_id, page_id % 4 + page_id % 3 AS images, page_id % 4 AS captioned, round(CASE WHEN page_id % 4 + page_id % 3 > 0 THEN (page_id % 4) / (page_id % 4 + page_id % 3)::DOUBLE ELSE 0 END, 6) AS coverage FROM pages WHERE NOT contains(lower(html), '<img')")(
    lambda t: readers.image_records(t.pages.where(~F.lower("html").contains("<img")).select("page_id", F.expr(IMAGES.replace("::INT", "")).alias("html")))
)
