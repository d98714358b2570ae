"""Queries of readers and sinks (SRC rows): records are made from driver tables, written as files where a reader takes files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.plugins import embedded
from ..session import shared_dir
from ..sources import readers as R
from ..sources import sinks as K
from ..sources.paged import export_pages, paged_records
from ..sources.schemas import FEEDBACK
from ..streaming.pipelines import retried
from .registry import Tables, query
from .text_queries import TEXT_OF_HTML

c = F.col


def folder(t: Tables, name: str) -> str:
    return shared_dir(t.spark, name)


def raw(df: DataFrame, **fields) -> DataFrame:
    return df.select(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("raw"))


def pages(t: Tables) -> DataFrame:
    n = c("page_id")
    return raw(
        t.pages, id=n.cast("string"), title=F.concat(F.lit("p"), n), space=F.struct(F.when(n % 2 == 0, "ENG-1").otherwise("HR").alias("key")),
        version=F.struct((n % 5).cast("int").alias("number"), F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("when"), F.struct(F.lit("ann").alias("displayName")).alias("by")),
        body=F.struct(F.struct(c("html").alias("value")).alias("storage")),
    )


def tickets(t: Tables) -> DataFrame:
    return raw(
        t.orders, key=F.concat(F.lit("PROJ-"), "o_orderkey"),
        fields=F.struct(F.concat(F.lit("order "), "o_orderkey").alias("summary"), c("o_orderstatus").alias("description"), F.struct(c("o_orderstatus").alias("name")).alias("status"), F.struct(F.array(F.struct(F.struct(F.lit("bob").alias("displayName")).alias("author"), F.lit("done").alias("body"))).alias("comments")).alias("comment")),
    )


def changes(t: Tables) -> DataFrame:
    return raw(t.part, id=F.sha1(c("p_partkey").cast("string")), title=F.concat(F.lit("part "), "p_partkey"), message=F.lit("changed"), author_name=F.lit("eve"), created_at=F.lit("2024-01-01"), diffs=F.array(F.struct(F.lit("a.py").alias("new_path"), F.repeat(F.lit("x"), 300).alias("diff"))))


def requests(t: Tables) -> DataFrame:
    return raw(t.supplier, iid=c("s_suppkey"), title=F.concat(F.lit("mr "), "s_suppkey"), description=F.lit("text"), state=F.lit("open"), discussions=F.array(F.struct(F.array(F.struct(F.lit("bob").alias("author"), F.lit("ok").alias("body"))).alias("notes"))))


DOC = "source_id, title, content"
query("SRC01_document_contract", f"SELECT page_id::VARCHAR AS source_id, 'confluence' AS source_type, 'p' || page_id AS title, 'html' AS content_type, sha256({TEXT_OF_HTML}) AS hash FROM pages")(
    lambda t: R.wiki_pages(pages(t)).select("source_id", "source_type", "title", "content_type", F.sha2("content", 256).alias("hash"))
)
query("SRC02_incremental_pages", "SELECT page_id::VARCHAR AS source_id, 'p' || page_id AS title FROM pages WHERE page_id % 28 + 1 > 14")(lambda t: R.since(R.wiki_pages(pages(t)), "2024-01-14").select("source_id", "title"))
@query("SRC02_paged_scan", "SELECT o_orderkey::BIGINT AS id, strftime(o_orderdate, '%Y-%m-%d') || 'T12:00:00' AS updated_at, o_orderpriority AS body FROM orders WHERE o_orderdate >= DATE '1997-01-01'")
def paged_scan(t: Tables) -> DataFrame:
    """Orders as exported records, read page by page from a day on."""
    path = shared_dir(t.spark, "export")
    export_pages(t.orders.select(c("o_orderkey").cast("long").alias("id"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T12:00:00")).alias("updated_at"), c("o_orderpriority").alias("body")), path)
    return paged_records(t.spark, path, "id long, updated_at string, body string", since="1997-01-01")


query("SRC03_wiki_pages", "SELECT page_id::VARCHAR AS source_id, (page_id % 5)::VARCHAR AS version, CASE WHEN page_id % 2 = 0 THEN 'ENG-1' ELSE 'HR' END AS space FROM pages")(lambda t: R.wiki_pages(pages(t)).select("source_id", c("metadata")["version"].alias("version"), c("metadata")["space"].alias("space")))
query("SRC05_issue_scan", "SELECT 'PROJ-' || o_orderkey AS source_id FROM orders WHERE o_orderstatus = 'O'")(lambda t: R.issues(tickets(t)).where(c("metadata")["status"] == "O").select("source_id"))
query("SRC06_issues", "SELECT 'PROJ-' || o_orderkey AS source_id, o_orderstatus || chr(10) || chr(10) || 'bob: done' AS content FROM orders")(lambda t: R.issues(tickets(t)).select("source_id", "content"))
query("SRC07_repo_scan", "SELECT 'part ' || p_partkey AS title, 'changed' || chr(10) || chr(10) || 'a.py' || chr(10) || repeat('x', 200) AS content FROM part")(lambda t: R.commits(changes(t)).select("title", "content"))
query("SRC29_merge_requests", "SELECT s_suppkey::VARCHAR AS source_id, 'text' || chr(10) || chr(10) || 'bob: ok' AS content FROM supplier")(lambda t: R.merge_requests(requests(t)).select("source_id", "content"))


@query("SRC09_collected_families", "SELECT 'confluence' AS source_type, count(*) AS n FROM pages UNION ALL SELECT 'jira', count(*) FROM orders UNION ALL SELECT 'gitlab_commit', count(*) FROM part UNION ALL SELECT 'gitlab_mr', count(*) FROM supplier")
def collected(t: Tables) -> DataFrame:
    base = folder(t, "families")
    for name, made in (("confluence", pages), ("jira", tickets), ("commits", changes), ("merge_requests", requests)):
        made(t).write.text(f"{base}/{name}")
    return R.collect_documents(t.spark, base, ("confluence", "jira", "commits", "merge_requests")).groupBy("source_type").agg(F.count("*").alias("n"))


def chats(t: Tables) -> DataFrame:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"), x["turn"].cast("double").alias("create_time")))
    return t.conversations.groupBy("conv_id").agg(rows.alias("m")).select(F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("title"), c("m").alias("messages"))).alias("raw"))


query("SRC10_chat_exports", "SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")(lambda t: R.conversations(chats(t)).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))
query(
    "SRC11_markup_docs",
    r"""WITH m AS (SELECT doc_id, '# T' || chr(10) || text || chr(10) || '[a](b)' AS t FROM documents)
    SELECT doc_id, len(regexp_extract_all(t, '(?m)^#{1,6}\s+\S'))::INT AS headings, len(regexp_extract_all(t, '(?s)```.*?```|----\n.*?\n----'))::INT AS code_blocks, array_to_string(regexp_extract_all(t, '\[[^\]]+\]\(([^)]+)\)|`[^`<]*<([^>]+)>`_', 1), ' ') AS links FROM m""",
)(
    lambda t: R.markup_sections(t.documents.select("doc_id", F.concat(F.lit("# T\n"), "text", F.lit("\n[a](b)")).alias("text")), F.lit("md")).select("doc_id", c("headings").cast("int").alias("headings"), F.size("code_blocks").alias("code_blocks"), F.array_join("links", " ").alias("links"))
)
query("SRC13_images", "SELECT page_id, '/i' || page_id || '.png' AS src, 'x' AS alt FROM pages")(lambda t: R.images(t.pages.select("page_id", F.format_string('<p><img src="/i%s.png" alt="x"></p>', "page_id").alias("html"))))


@query("SRC15_chunk_sink", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def chunk_sink(t: Tables) -> DataFrame:
    path = folder(t, "chunks")
    K.write_chunks(t.documents, path, "source")
    return t.spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@query("SRC16_index_upsert", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS ts FROM documents")
def index_upsert(t: Tables) -> DataFrame:
    first, second = folder(t, "index"), folder(t, "index")
    K.upsert_snapshot(t.spark, t.documents.select(c("doc_id").alias("id"), F.lit(1).alias("ts")), None, first)
    return K.upsert_snapshot(t.spark, t.documents.where("doc_id % 3 = 0").select(c("doc_id").alias("id"), F.lit(2).alias("ts")), first, second)


@query("SRC18_cold_history", "SELECT operation, count(*) AS n FROM (SELECT 'upsert' AS operation FROM documents UNION ALL SELECT 'delete' FROM documents WHERE doc_id % 5 = 0) GROUP BY 1")
def cold_history(t: Tables) -> DataFrame:
    path = folder(t, "cold")
    K.append_history(t.documents.select("doc_id", F.lit("upsert").alias("operation")), path)
    K.append_history(t.documents.where("doc_id % 5 = 0").select("doc_id", F.lit("delete").alias("operation")), path)
    return t.spark.read.parquet(path).groupBy("operation").agg(F.count("*").alias("n"))


@query("SRC20_append_log", "SELECT event_type AS type, count(*) * 2 AS n FROM events GROUP BY 1")
def append_log(t: Tables) -> DataFrame:
    path = folder(t, "log")
    rows = t.events.select(c("event_id").cast("string").alias("id"), c("event_type").alias("type"), c("user_id").cast("string").alias("user"))
    K.append_log(rows, path)
    K.append_log(rows, path)
    return R.log(t.spark, path).groupBy("type").agg(F.count("*").alias("n"))




@query(
    "SRC33_audit_writers",
    """WITH e AS (SELECT *, event_id % 6 AS k, 'question ' || event_id AS q, floor(value)::BIGINT AS tok FROM events)
    SELECT CASE k WHEN 0 THEN 'query' WHEN 1 THEN 'access_denied' WHEN 2 THEN 'config_change' WHEN 3 THEN 'error' WHEN 4 THEN 'trace' ELSE CASE WHEN user_id % 2 = 0 THEN 'login' ELSE 'auth' END END AS type, user_id::VARCHAR AS user,
        CASE WHEN k IN (0, 4) THEN substr(sha256(q), 1, 16) ELSE 'n/a' END AS hash, CASE WHEN k IN (0, 4) THEN tok ELSE 0 END AS tokens,
        CASE k WHEN 1 THEN 'denied' WHEN 3 THEN 'error' WHEN 4 THEN CASE WHEN user_id % 3 = 0 OR value >= 50 THEN 'success' ELSE 'low_confidence' END WHEN 5 THEN CASE WHEN event_id % 4 = 1 THEN 'success' ELSE 'failure' END ELSE 'success' END AS status,
        CASE k WHEN 0 THEN q WHEN 1 THEN 'role' WHEN 2 THEN CASE WHEN length(props) > 20 THEN left(props, 4) || '***' || right(props, 4) ELSE '***' END WHEN 3 THEN left(props, 500) WHEN 4 THEN greatest(0, tok - length(q) // 4)::VARCHAR ELSE (event_id % 4 = 1)::VARCHAR END AS detail FROM e""",
)
def audit(t: Tables) -> DataFrame:
    """Six kinds of audit events written to one log and read back."""
    path, e = folder(t, "audit"), t.events
    when, user, q, tokens = c("ts"), c("user_id"), F.concat(F.lit("question "), c("event_id")), F.floor("value")
    part = lambda k: e.where(c("event_id") % 6 == k)
    chance = F.when(c("user_id") % 3 != 0, c("value") / 100)
    for rows in (
        K.audit_query(part(0), when, user, q, c("props"), F.lit(3), c("value"), tokens),
        K.audit_denied(part(1), when, user, F.lit("/kb"), F.lit("role")),
        K.audit_config(part(2), when, user, F.lit("limit"), c("props"), c("props")),
        K.audit_error(part(3), when, user, c("event_type"), c("props"), F.lit(None).cast("string"), F.lit("/v1")),
        K.audit_trace(part(4), when, user, q, F.lit(2), F.array(c("value")), tokens, chance, c("value")),
        K.audit_auth(part(5), when, user, F.when(c("user_id") % 2 == 0, "login").otherwise("logout"), c("event_id") % 4 == 1),
    ):
        K.append_log(rows, path)
    detail = F.coalesce(*[c("details")[k] for k in ("reason", "new_value", "error_message", "estimated_prompt_tokens", "success", "query_preview")])
    return R.log(t.spark, path).select("type", "user", "hash", c("tokens_used").alias("tokens"), "status", detail.alias("detail"))


@query("SRC22_eval_set", "SELECT 'q' || item_id AS query, 1::BIGINT AS n FROM benchmark")
def eval_set(t: Tables) -> DataFrame:
    path = folder(t, "eval")
    good = t.benchmark.select(F.to_json(F.struct(F.concat(F.lit("q"), "item_id").alias("query"), F.array(F.lit("d1")).alias("relevant_docs"))).alias("value"))
    good.union(t.spark.createDataFrame([("# note",), ("",), ("{broken",)], "value string")).write.text(path)
    return R.eval_set(t.spark, path).select("query", F.size("relevant_docs").cast("long").alias("n"))




@query("SRC23_feedback_table", "SELECT event_id::VARCHAR AS feedback_id, user_id::VARCHAR AS user_id, event_type AS rating, value / 100 AS confidence, (event_id % 5)::INT AS retrieval_quality, 20::BIGINT AS columns FROM events")
def feedback_table(t: Tables) -> DataFrame:
    """The feedback table with its explicit schema, written and read back; fields that events lack are null."""
    path = folder(t, "feedback")
    known = {"feedback_id": c("event_id"), "user_id": c("user_id"), "rating": c("event_type"), "confidence": c("value") / 100, "retrieval_quality": c("event_id") % 5, "created_at": c("ts"), "question": c("props")}
    schema = StructType.fromDDL(FEEDBACK)
    t.events.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)
    return t.spark.read.schema(FEEDBACK).parquet(path).select("feedback_id", "user_id", "rating", "confidence", "retrieval_quality", F.lit(len(schema)).cast("long").alias("columns"))


query("SRC24_kb_tables", "SELECT c_custkey::VARCHAR AS kb_id, count(o_orderkey) AS tasks FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")(lambda t: t.customer.join(t.orders, c("o_custkey") == c("c_custkey"), "left").groupBy(c("c_custkey").cast("string").alias("kb_id")).agg(F.count("o_orderkey").alias("tasks")))
query("SRC25_dlq_table", "SELECT event_id, CASE WHEN event_id % 4 + 1 >= 3 THEN 'dead' ELSE 'pending' END AS status FROM events WHERE event_type = 'error'")(
    lambda t: retried(t.events.where("event_type = 'error'").select("event_id", (c("event_id") % 4).alias("retry_count"), F.lit(0.0).alias("now"))).select("event_id", "status")
)


@query("SRC26_training_sets", "SELECT 'dialogues' AS name, count(*) FILTER (event_type = 'click') AS n FROM events UNION ALL SELECT 'preferences', count(*) FROM events UNION ALL SELECT 'rerank', count(*) FROM events")
def training(t: Tables) -> DataFrame:
    path = folder(t, "training")
    rows = t.events.select(F.concat(F.lit("q"), "event_id").alias("query"), c("props").alias("answer"), F.when(c("event_type") == "click", "positive").otherwise("negative").alias("rating"), F.array(F.struct(c("event_type").alias("chunk_id"), F.lit(1).alias("relevance_score"))).alias("chunks"))
    K.training_sets(rows, path)
    out = None
    for name in ("dialogues", "preferences", "rerank"):
        part = t.spark.read.text(f"{path}/{name}").select(F.lit(name).alias("name")).groupBy("name").agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


query("UDF06_batch_embedder", "SELECT item_id, length(text)::DOUBLE AS chars, len(regexp_extract_all(text, ' '))::DOUBLE AS spaces FROM benchmark")(lambda t: embedded(t.benchmark.select("item_id", "text"), lambda texts: [[float(len(x)), float(x.count(" "))] for x in texts]).select("item_id", c("embedding")[0].cast("double").alias("chars"), c("embedding")[1].cast("double").alias("spaces")))
