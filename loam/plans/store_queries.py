"""Queries of stores, versions, sets, joins and access control (SRC, JOI, SET, WIN, INC, FLT rows).

documents serve as chunks: a stored snapshot holds those whose number is no
multiple of 7, the new one those that are no multiple of 11, texts of
multiples of 13 changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import acl
from ..operators import analytics as A
from ..operators import chunking as C
from ..operators import compression as M
from ..operators import versioning as V
from ..session import shared_dir
from ..sources import snapshots as N
from .registry import Tables, query

c = F.col


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents.select(c("source").alias("doc_id"), c("doc_id").alias("n"), "text")
    h = lambda x: F.sha2(x, 256).alias("hash")
    new = d.where("n % 11 <> 0").select("doc_id", "n", h(F.when(c("n") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(c("text"))))
    return new, d.where("n % 7 <> 0").select("doc_id", "n", h(c("text")))


SNAP = "WITH s AS (SELECT source AS doc_id, doc_id AS n, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0), w AS (SELECT source AS doc_id, doc_id AS n, sha256(CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0), ad AS (SELECT DISTINCT doc_id, hash FROM w ANTI JOIN s USING (doc_id, hash)), de AS (SELECT DISTINCT doc_id, hash FROM s ANTI JOIN w USING (doc_id, hash))"
query("JOI02_chunk_changes", f"{SNAP} SELECT *, 'added' AS change FROM ad UNION ALL SELECT *, 'deleted' FROM de")(lambda t: V.changes(*snapshots(t)))
query("SET02_hash_difference", f"{SNAP} SELECT hash FROM (SELECT hash FROM w EXCEPT SELECT hash FROM s)")(lambda t: (lambda n, s: n.select("hash").subtract(s.select("hash")))(*snapshots(t)))
query("INC01_sync_counts", f"{SNAP} SELECT doc_id, count(*) FILTER (a) AS added, count(*) FILTER (NOT a) AS deleted FROM (SELECT doc_id, true AS a FROM ad UNION ALL SELECT doc_id, false FROM de) GROUP BY 1")(
    lambda t: V.changes(*snapshots(t)).groupBy("doc_id").agg(F.count_if(c("change") == "added").alias("added"), F.count_if(c("change") == "deleted").alias("deleted"))
)
query("INC02_bulk_sync", f"{SNAP} SELECT (SELECT count(*) FROM ad) AS added, (SELECT count(*) FROM de) AS deleted")(lambda t: V.changes(*snapshots(t)).agg(F.count_if(c("change") == "added").alias("added"), F.count_if(c("change") == "deleted").alias("deleted")))
query("INC09_changed_only", f"{SNAP} SELECT doc_id, hash FROM ad")(lambda t: V.changes(*snapshots(t)).where("change = 'added'").select("doc_id", "hash"))
query("SRC04_changed_pages", "SELECT page_id FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0")(
    lambda t: (lambda now, wal: now.join(wal, ["page_id", "hash"], "left_anti").select("page_id"))(
        t.pages.select("page_id", F.sha2(F.concat_ws("|", "html", "url"), 256).alias("hash")), t.pages.where("page_id % 3 <> 0").select("page_id", F.sha2(F.concat_ws("|", F.when(c("page_id") % 5 == 0, F.lit("old")).otherwise(c("html")), "url"), 256).alias("hash"))
    )
)
query("SRC30_changed_commits", "SELECT page_id FROM pages WHERE page_id % 4 = 0")(lambda t: (lambda d: d.join(d.where("page_id % 4 <> 0"), ["page_id", "sha"], "left_anti").select("page_id"))(t.pages.select("page_id", F.sha1("html").alias("sha"))))
query("SRC17_point_deletes", "SELECT doc_id FROM documents WHERE doc_id % 9 <> 4")(lambda t: t.documents.select("doc_id").join(t.documents.where("doc_id % 9 = 4").select("doc_id"), "doc_id", "left_anti"))
query("SRC34_stripped_chunks", "SELECT sha256(text) AS hash, source AS source_id, '1' AS version, 'd' || doc_id AS doc_title, lang AS source_type FROM documents")(
    lambda t: t.documents.select(F.sha2("text", 256).alias("hash"), c("source").alias("source_id"), F.lit("1").alias("version"), F.concat(F.lit("d"), "doc_id").alias("doc_title"), c("lang").alias("source_type"))
)
query("SRC35_upserts", "SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 1 ELSE 2 END AS v FROM (SELECT doc_id FROM documents) a LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0) b USING (doc_id)")(
    lambda t: V.upsert(t.documents.select("doc_id", F.lit(1).alias("v")), t.documents.where("doc_id % 4 = 0").select("doc_id", F.lit(2).alias("v")), "doc_id", "v")
)


@query(
    "SRC35_point_writes",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 1 THEN 'pending' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 1 THEN 0 ELSE o_orderkey % 4 END::INT AS retry_count,
        CASE WHEN o_orderkey % 5 = 2 THEN 'noted' ELSE o_orderpriority END AS note, CASE WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS deleted_at FROM orders WHERE o_orderkey % 5 <> 0
    UNION ALL SELECT -o_orderkey, 'new', 1, NULL, NULL FROM orders WHERE o_orderkey % 50 = 0 AND o_orderkey > 0""",
)
def point_writes(t: Tables) -> DataFrame:
    """Messages put at once, then acknowledged, requeued, changed in one column, softly deleted and put anew in a second write."""
    kept = N.Snapshot(t.spark, shared_dir(t.spark, "messages"), "id long, status string, retry_count int, note string, deleted_at string", "id", 16)
    o = t.orders.withColumn("id", c("o_orderkey").cast("long"))
    kept.write(N.changes(o.select("id", c("o_orderstatus").alias("status"), (c("id") % 4).cast("int").alias("retry_count"), c("o_orderpriority").alias("note")), N.PUT))
    some = lambda r: o.where(c("id") % 5 == r)
    parts = [
        N.acknowledged(some(0), "id"), N.requeued(some(1), "id"), N.changes(some(2).select("id"), N.CHANGE, note=F.lit("noted")), N.softly_deleted(some(3), "id", F.lit(None).cast("string")),
        N.changes(some(3).select("id", c("o_orderdate").cast("date").cast("string").alias("deleted_at")), N.CHANGE, seq=1),
        N.changes(o.where((c("id") % 50 == 0) & (c("id") > 0)).select((-c("id")).alias("id"), F.lit("new").alias("status"), F.lit(1).alias("retry_count")), N.PUT),
    ]
    kept.write(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    return kept.read()


FILTER = ["*.md", "docs/*", "test"]


def path_kept(path, exclude: list[str], include: list[str]):
    """Excluded by suffix (*.x), folder (dir/*) or substring; then, if anything is included, by suffix or substring."""
    hit = lambda p: path.endswith(p[1:]) if p.startswith("*.") else path.startswith(p[:-1]) if p.endswith("/*") else path.contains(p)
    out = F.lit(False)
    for p in exclude:
        out = out | hit(p)
    keep = F.lit(not include)
    for p in include:
        keep = keep | hit(p)
    return ~out & keep


PATHS = "(['docs/', 'src/', 'lib/test', ''])[(page_id % 4 + 1)::INT] || 'f' || page_id || (['.md', '.py', '.txt'])[(page_id % 3 + 1)::INT]"
query("SRC08_path_filter", f"SELECT page_id, p AS path FROM (SELECT page_id, {PATHS} AS p FROM pages) WHERE NOT (ends_with(p, '.md') OR starts_with(p, 'docs/') OR contains(p, 'test')) AND (ends_with(p, '.py') OR contains(p, 'f1'))")(
    lambda t: t.pages.select("page_id", F.concat(F.element_at(F.array(*map(F.lit, ("docs/", "src/", "lib/test", ""))), (c("page_id") % 4 + 1).cast("int")), F.lit("f"), c("page_id"), F.element_at(F.array(*map(F.lit, (".md", ".py", ".txt"))), (c("page_id") % 3 + 1).cast("int"))).alias("path")).where(path_kept(c("path"), FILTER, ["*.py", "f1"]))
)
query("SRC14_payload_acl", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'restricted' WHEN page_id % 5 = 0 THEN 'internal' ELSE 'public' END AS level, array_to_string(CASE WHEN page_id % 3 = 0 THEN ['eng', 'hr'] ELSE [] END, ',') AS groups FROM pages")(
    lambda t: t.pages.select("page_id", F.when(c("page_id") % 3 == 0, "restricted").when(c("page_id") % 5 == 0, "internal").otherwise("public").alias("level"), F.array_join(F.array_distinct(F.when(c("page_id") % 3 == 0, F.array(F.lit("eng"), F.lit("hr"), F.lit("eng"))).otherwise(F.array().cast("array<string>"))), ",").alias("groups"))
)
query("SET05_ordered_distinct", "SELECT doc_id, array_to_string(CASE WHEN lang = source THEN [lang] ELSE [lang, source] END, ',') AS tags FROM documents")(lambda t: t.documents.select("doc_id", F.array_join(F.array_distinct(F.array("lang", "source", "lang")), ",").alias("tags")))
query("SRC31_chat_format", "SELECT doc_id, CASE WHEN contains(left(text, 4096), 'Q:') THEN 'qa' WHEN contains(left(text, 4096), '{') THEN 'json' ELSE 'text' END AS format FROM documents")(
    lambda t: t.documents.select("doc_id", F.when(F.substring("text", 1, 4096).contains("Q:"), "qa").when(F.substring("text", 1, 4096).contains("{"), "json").otherwise("text").alias("format"))
)
query("SET01_family_union", "SELECT 'document' AS family, doc_id AS id, sha256(text) AS hash FROM documents UNION ALL SELECT 'page', page_id, sha256(html) FROM pages UNION ALL SELECT 'turn', conv_id * 1000 + turn, sha256(text) FROM conversations UNION ALL SELECT 'item', item_id, sha256(text) FROM benchmark")(
    lambda t: t.documents.select(F.lit("document").alias("family"), c("doc_id").alias("id"), F.sha2("text", 256).alias("hash")).unionByName(t.pages.select(F.lit("page").alias("family"), c("page_id").alias("id"), F.sha2("html", 256).alias("hash"))).unionByName(t.conversations.select(F.lit("turn").alias("family"), (c("conv_id") * 1000 + c("turn")).alias("id"), F.sha2("text", 256).alias("hash"))).unionByName(t.benchmark.select(F.lit("item").alias("family"), c("item_id").alias("id"), F.sha2("text", 256).alias("hash")))
)

# ---- versions and history

VERS = "WITH v AS (SELECT source AS source_id, doc_id AS pos, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE (doc_id % 4) || '.' || (doc_id % 13) END AS version FROM documents), k AS (SELECT *, coalesce(split_part(version, '.', 1)::INT, 0) AS a, coalesce(split_part(version, '.', 2)::INT, -1) AS b FROM v)"
versions = lambda t: t.documents.select(c("source").alias("source_id"), c("doc_id").alias("pos"), F.when(c("doc_id") % 17 != 0, F.concat_ws(".", c("doc_id") % 4, c("doc_id") % 13)).alias("version"))
query("WIN06_latest_version", f"{VERS} SELECT source_id, pos, version FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY a DESC, b DESC, pos) AS r FROM k) WHERE r = 1")(lambda t: V.resolve(versions(t)))
query("WIN06_requested_version", f"{VERS}, h AS (SELECT DISTINCT source_id FROM k WHERE version = '1.5') SELECT source_id, pos, version FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY a DESC, b DESC, pos) AS r FROM k) WHERE CASE WHEN source_id IN (FROM h) THEN coalesce(version = '1.5', false) ELSE r = 1 END")(lambda t: V.resolve(versions(t), "1.5"))
query("WIN06_all_of_latest", f"{VERS} SELECT source_id, pos, version FROM (SELECT *, rank() OVER (PARTITION BY source_id ORDER BY a DESC, b DESC) AS r FROM k) WHERE r = 1")(lambda t: V.resolve(versions(t), mode="all"))
query("WIN02_last_versions", f"{VERS} SELECT source_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY a DESC, pos DESC) AS r FROM k) WHERE r <= 5")(lambda t: V.last_rows(versions(t).withColumn("major", F.coalesce(F.split_part("version", F.lit("."), F.lit(1)).cast("int"), F.lit(0))), "source_id", [F.desc("major"), F.desc("pos")], 5).select("source_id", "pos"))
query("INC07_version_retention", f"{VERS} SELECT source_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY a DESC, pos DESC) AS r FROM k) WHERE r > 5")(
    lambda t: versions(t).withColumn("major", F.coalesce(F.split_part("version", F.lit("."), F.lit(1)).cast("int"), F.lit(0))).withColumn("r", F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("major"), F.desc("pos")))).where("r > 5").select("source_id", "pos")
)
HIST = "WITH h AS (SELECT user_id AS doc_id, event_type AS hash, ts, event_id, CASE WHEN event_id % 4 = 0 THEN 'delete' ELSE 'upsert' END AS operation FROM events)"
history = lambda t: t.events.select(c("user_id").alias("doc_id"), c("event_type").alias("hash"), "ts", "event_id", F.when(c("event_id") % 4 == 0, "delete").otherwise("upsert").alias("operation"))
for name, n in (("WIN03_history_keep", 10), ("WIN04_history_tail", 100), ("INC03_document_history", 50)):
    query(name, f"{HIST} SELECT doc_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts DESC, event_id DESC) AS r FROM h) WHERE r <= {n}")(lambda t, n=n: V.last_rows(history(t), "doc_id", [F.desc("ts"), F.desc("event_id")], n).select("doc_id", "event_id"))
MID = "TIMESTAMP '2024-01-16'"
mid = lambda: F.lit("2024-01-16").cast("timestamp_ntz")
query("INC04_as_of", f"{HIST} SELECT doc_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, hash ORDER BY ts DESC, operation DESC) AS r FROM h WHERE ts <= {MID}) WHERE r = 1 AND operation = 'upsert'")(lambda t: V.as_of(history(t), mid()).select("doc_id", "hash"))
query("INC04_rollback_first", f"{HIST} SELECT doc_id, hash, min(ts) AS ts FROM h WHERE ts <= {MID} AND operation = 'upsert' GROUP BY ALL")(lambda t: V.as_of(history(t), mid(), legacy=True).select("doc_id", "hash", "ts"))
query("INC06_vacuum", f"{HIST} SELECT event_id FROM h WHERE ts >= {MID}")(lambda t: history(t).where(c("ts") >= mid()).select("event_id"))
query("INC08_reindex_tasks", f"{HIST} SELECT doc_id, max(ts) AS last, 'reindex' AS task FROM h GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30'")(lambda t: history(t).groupBy("doc_id").agg(F.max("ts").alias("last")).where(c("last") < F.lit("2024-01-30").cast("timestamp_ntz")).withColumn("task", F.lit("reindex")))
query("INC10_current_snapshot", f"{HIST} SELECT doc_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, hash ORDER BY ts DESC, event_id DESC) AS r FROM h WHERE doc_id <> 3) WHERE r = 1")(
    lambda t: history(t).where("doc_id <> 3").withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "hash").orderBy(F.desc("ts"), F.desc("event_id")))).where("r = 1").select("doc_id", "hash")
)
query("INC11_update_events", f"{HIST} SELECT doc_id, count(*) AS version FROM h WHERE operation = 'upsert' GROUP BY 1")(lambda t: history(t).where("operation = 'upsert'").groupBy("doc_id").agg(F.count("*").alias("version")))
query("WIN14_latest_production", "WITH m AS (SELECT o_custkey AS name, o_orderkey AS version, CASE o_orderstatus WHEN 'O' THEN 'production' ELSE 'archived' END AS status FROM orders) SELECT name, status, max(version) AS version FROM m GROUP BY ALL")(
    lambda t: t.orders.select(c("o_custkey").alias("name"), c("o_orderkey").alias("version"), F.when(c("o_orderstatus") == "O", "production").otherwise("archived").alias("status")).groupBy("name", "status").agg(F.max("version").alias("version"))
)
query("FUN59_promotion", "SELECT o_custkey AS name, o_orderkey AS version, CASE WHEN r = 1 THEN 'production' WHEN r = 2 THEN 'archived' ELSE 'staging' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)")(
    lambda t: t.orders.withColumn("r", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))).select(c("o_custkey").alias("name"), c("o_orderkey").alias("version"), F.when(c("r") == 1, "production").when(c("r") == 2, "archived").otherwise("staging").alias("status"))
)

# ---- windows over chunks

query("WIN05_first_seen", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")(lambda t: t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
query(
    "WIN07_overlap",
    """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents),
    o AS (SELECT doc_id, position, x AS chunk FROM l WHERE position = 0 UNION ALL
        SELECT l.doc_id, l.position, CASE WHEN chunk = '' THEN x ELSE '[previous context: ...' || right(chunk, 40) || ']' || chr(10) || chr(10) || x END FROM o JOIN l ON l.doc_id = o.doc_id AND l.position = o.position + 1)
    SELECT doc_id, position::INT AS position, chunk FROM o""",
)(lambda t: C.overlap(t.documents.select("doc_id", F.split("text", "\n").alias("chunks")), 40))
query("WIN09_carry_forward", "SELECT doc_id, last_value(CASE WHEN doc_id % 3 = 0 THEN doc_id END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS key FROM documents")(
    lambda t: A.carried(t.documents.select("source", "doc_id"), ["source"], [c("doc_id")], F.when(c("doc_id") % 3 == 0, c("doc_id")), "key").select("doc_id", "key")
)
BUD = "WITH r AS (SELECT source, doc_id, length(text) // 4 AS cost, sum(length(text) // 4) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS used FROM documents)"


def running(t: Tables) -> DataFrame:
    """source, doc_id, cost and used, the cost of the source's larger documents and its own."""
    rows = t.documents.select("source", "n_chars", "doc_id", T.quarter_tokens(c("text")).alias("cost"))
    return A.running(rows, ["source"], [F.desc("n_chars"), c("doc_id")], {"used": c("cost")})


query("FLT17_prefix_fit", f"{BUD} SELECT doc_id FROM r WHERE used <= 8000")(lambda t: running(t).where("used <= 8000").select("doc_id"))
query("WIN11_budget_cutoff", f"{BUD} SELECT doc_id, least(cost, 8000 - (used - cost))::BIGINT AS tokens, used > 8000 AS truncated FROM r WHERE used <= 8000 OR (used - cost <= 8000 AND 8000 - (used - cost) > 50)")(
    lambda t: running(t).where("used <= 8000 or (used - cost <= 8000 and 8000 - (used - cost) > 50)").select("doc_id", F.least(c("cost"), 8000 - (c("used") - c("cost"))).alias("tokens"), (c("used") > 8000).alias("truncated"))
)
CUT = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 15)"
query(
    "FLT13_signature_dedup",
    rf"""WITH s AS (SELECT doc_id, text, (doc_id * 37 % 100) / 100.0::DOUBLE AS score FROM documents WHERE (doc_id * 37 % 100) >= 20 AND regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 120)) ORDER BY doc_id) AS r FROM s) WHERE r = 1)
    SELECT doc_id, score, sha256(CASE WHEN length(text) > 3000 AND len({CUT}) > 0 THEN array_to_string({CUT}[1:10], ' ') ELSE text END) AS text FROM k""",
)(lambda t: M.decomposed(t.documents.select("doc_id", "text", ((c("doc_id") * 37 % 100) / 100).alias("score"))).select("doc_id", "score", F.sha2("text", 256).alias("text")))
SENT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
query("FLT14_strips", f"SELECT doc_id, i - 1 AS at, s AS strip FROM (SELECT doc_id, unnest({SENT}) AS s, generate_subscripts({SENT}, 1) AS i FROM documents) WHERE length(s) >= 10")(
    lambda t: t.documents.select("doc_id", F.posexplode(T.sentences(c("text"))).alias("at", "strip")).where(F.length("strip") >= 10).select("doc_id", c("at").cast("long").alias("at"), "strip")
)
query("AGG25_semantic_groups", "SELECT source || lang AS key, count(*) AS n, round(avg(n_chars), 6) AS score, min(doc_id) AS first, length(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS chars FROM documents GROUP BY 1")(
    # the joined text's length is that of its parts and the breaks between them; the text itself is never gathered
    lambda t: t.documents.groupBy(F.concat("source", "lang").alias("key")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("score"), F.min("doc_id").alias("first"), (F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("chars"))
)
query("AGG26_semantic_packs", "SELECT source AS key, (sum(length(text)) + (count(*) - 1) * 7)::BIGINT AS chars, array_to_string(list_sort(list_distinct(list(lang))), ',') AS keywords FROM documents GROUP BY 1")(
    lambda t: t.documents.groupBy(c("source").alias("key")).agg((F.sum(F.length("text")) + (F.count("*") - 1) * 7).alias("chars"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("keywords"))
)
query("CMP07_assembled", f"WITH u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1), b AS (SELECT source, doc_id, sum(length(text) // 4) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS used FROM u) SELECT source, count(*) AS chunks FROM b WHERE used <= 20000 GROUP BY 1")(
    lambda t: A.running(
        t.documents.groupBy(F.sha2("text", 256)).agg(F.min_by(F.struct("source", "n_chars", "doc_id", T.quarter_tokens(c("text")).alias("cost")), "doc_id").alias("x")).select("x.*"),
        ["source"], [F.desc("n_chars"), c("doc_id")], {"used": c("cost")},
    ).where("used <= 20000").groupBy("source").agg(F.count("*").alias("chunks"))
)

# ---- access

ROLES = ["admin", "expert", "developer", "viewer", "external"]


def chunks(t: Tables) -> DataFrame:
    d = c("doc_id")
    return t.documents.select("doc_id", F.element_at(F.array(*map(F.lit, acl.LEVELS)), (d % 4 + 1).cast("int")).alias("access_level"), F.when(d % 3 == 0, F.array(F.concat(F.lit("g"), d % 5))).otherwise(F.array().cast("array<string>")).alias("allowed_groups"), F.when(d % 2 == 1, F.array(F.concat(F.lit("u"), d % 25))).otherwise(F.array().cast("array<string>")).alias("allowed_users"))


def users(t: Tables) -> DataFrame:
    n = c("n_nationkey")
    return t.nation.select(F.concat(F.lit("u"), n).alias("username"), F.array(F.element_at(F.array(*map(F.lit, ROLES)), (n % 5 + 1).cast("int"))).alias("roles"), F.when(n % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("g"), n % 5))).alias("groups"))


ACL = f"""WITH k AS (SELECT doc_id, (['public', 'internal', 'confidential', 'restricted'])[(doc_id % 4 + 1)::INT] AS level, doc_id % 4 AS lr, CASE WHEN doc_id % 3 = 0 THEN 'g' || (doc_id % 5) END AS g, CASE WHEN doc_id % 2 = 1 THEN 'u' || (doc_id % 25) END AS u FROM documents),
    n AS (SELECT 'u' || n_nationkey AS username, ({ROLES})[(n_nationkey % 5 + 1)::INT] AS role, ([3, 2, 2, 1, 0])[(n_nationkey % 5 + 1)::INT] AS reach, CASE WHEN n_nationkey % 4 <> 0 THEN 'g' || (n_nationkey % 5) END AS own FROM nation)"""
SEES = "role = 'admin' OR (lr <= reach AND CASE level WHEN 'confidential' THEN own IS NOT NULL AND (g IS NULL OR g = own) WHEN 'restricted' THEN u IS NULL OR u = username ELSE true END)"
query("FLT03_role_filter", f"{ACL} SELECT username, doc_id FROM k JOIN n ON {SEES}")(lambda t: acl.pairs(chunks(t), users(t)).select("username", "doc_id"))
query("FLT04_role_levels", f"{ACL} SELECT username, array_to_string((['public', 'internal', 'confidential', 'restricted'])[1:reach + 1], ',') AS levels FROM n")(lambda t: users(t).select("username", F.array_join(acl.allowed_levels(c("roles")), ",").alias("levels")))
query("FLT01_pushed_filters", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2') AND n_chars > 500")(lambda t: t.documents.where((c("lang") == "en") & c("source").isin("src1", "src2") & (c("n_chars") > 500)).select("doc_id"))
query("FLT05_pushdown", f"{ACL} SELECT doc_id FROM k WHERE lr <= 1 OR (level = 'confidential' AND (g IS NULL OR g IN ('g0', 'g3')))")(lambda t: chunks(t).where(acl.pushdown(acl.LEVELS[:3], ["g0", "g3"], "u1")).select("doc_id"))
OWN = "role = 'admin' OR level = 'public' OR coalesce(u = username, false) OR coalesce(g = own, false)"


def owner_pairs(t: Tables) -> DataFrame:
    """Users and chunks by the domain rule: public chunks, named users and shared groups, each an equi-join."""
    k, u = chunks(t), users(t)
    seen = k.withColumn("_k", F.when(c("access_level") == "public", F.array(F.lit("*"))).otherwise(F.concat(c("allowed_users"), c("allowed_groups"), F.array(F.lit("admin")))))
    seen = seen.select("doc_id", F.explode("_k").alias("key")).distinct()
    keys = u.select("username", F.explode(F.concat(F.array(F.lit("*"), c("username")), c("groups"), F.when(acl.is_admin(c("roles")), F.array(F.lit("admin"))).otherwise(F.array().cast("array<string>")))).alias("key"))
    return seen.join(keys, "key").select("username", "doc_id").distinct()


query("FLT06_domain_access", f"{ACL} SELECT username, doc_id FROM k JOIN n ON {OWN}")(owner_pairs)
query("FLT16_domain_filter", f"{ACL} SELECT doc_id FROM k WHERE level = 'public' OR coalesce(u = 'u7', false) OR coalesce(g = 'g2', false)")(
    lambda t: chunks(t).where(acl.owner_visible(c("access_level"), c("allowed_groups"), c("allowed_users"), F.lit(False), F.array(F.lit("g2")), F.lit("u7"))).select("doc_id")
)
query("FLT07_source_document", f"{ACL} SELECT doc_id, lr <= 2 AND CASE level WHEN 'confidential' THEN g IS NULL OR g = 'g2' ELSE true END AS visible, doc_id % 6 <> 0 AS source_ok FROM k")(
    lambda t: chunks(t).select("doc_id", acl.document_visible(c("access_level"), c("allowed_groups"), c("allowed_users"), F.array(F.lit("developer")), F.array(F.lit("g2")), F.lit("u7")).alias("visible"), acl.source_visible(F.when(c("doc_id") % 6 == 0, "hr").otherwise("wiki"), F.array(F.lit("developer"))).alias("source_ok"))
)

# ---- joins


def numbered(t: Tables) -> DataFrame:
    """source, doc_id and i, its place in the source."""
    return A.running(t.documents.select("source", "doc_id"), ["source"], [c("doc_id")], {"i": F.lit(1)})


query("JOI06_neighbours", "WITH k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) SELECT DISTINCT b.doc_id FROM k a JOIN k b ON a.source = b.source AND abs(a.i - b.i) <= 2 WHERE a.doc_id % 100 = 0")(
    lambda t: (lambda k: k.where("doc_id % 100 = 0").select("source", F.explode(F.sequence(c("i") - 2, c("i") + 2)).alias("i")).join(k, ["source", "i"]).select("doc_id").distinct())(numbered(t))
)
query("JOI05_close_pairs", "WITH k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) SELECT a.doc_id AS a, b.doc_id AS b FROM k a JOIN k b ON a.source = b.source AND b.i > a.i AND b.i < a.i + 10")(
    lambda t: (lambda k: k.select("source", c("doc_id").alias("a"), F.explode(F.sequence(c("i") + 1, c("i") + 9)).alias("i")).join(k.select("source", "i", c("doc_id").alias("b")), ["source", "i"]).select("a", "b"))(numbered(t))
)
query("JOI07_feedback_lookup", "SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d USING (doc_id)")(lambda t: t.labels.join(t.documents.select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality"))
query("JOI08_word_communities", r"WITH s AS (SELECT source, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS w FROM documents), q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS w FROM benchmark) SELECT item_id, source, count(DISTINCT w) AS hits FROM q JOIN (SELECT DISTINCT source, w FROM s) USING (w) GROUP BY ALL")(
    lambda t: t.benchmark.select("item_id", F.explode(T.word_set(c("text"))).alias("w")).join(t.documents.select("source", F.explode(T.word_set(c("text"))).alias("w")).distinct(), "w").groupBy("item_id", "source").agg(F.count("*").alias("hits"))
)
RET15 = r"WITH s AS (SELECT DISTINCT source, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS w FROM documents), q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM q GROUP BY 1), g AS (SELECT item_id, source, round(count(*) / any_value(n)::DOUBLE, 6) AS score FROM q JOIN s USING (w) JOIN n USING (item_id) GROUP BY ALL)"
query("RET15_global_search", f"{RET15} SELECT item_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) AS r FROM g) WHERE r <= 5")(
    lambda t: (lambda q: q.join(t.documents.select("source", F.explode(T.word_set(c("text"))).alias("w")).distinct(), "w").groupBy("item_id", "source").agg(F.count("*").alias("hits")).join(q.groupBy("item_id").agg(F.count("*").alias("n")), "item_id").select("item_id", "source", F.round(c("hits") / c("n"), 6).alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "source"))).where("r <= 5").drop("r"))(
        t.benchmark.select("item_id", F.explode(T.word_set(c("text"))).alias("w"))
    )
)
query("JOI09_outdated_nodes", "SELECT doc_id FROM documents WHERE source IS NULL OR source NOT IN ('src1', 'src2', 'src3')")(lambda t: t.documents.select("doc_id", "source").join(t.documents.where(c("source").isin("src1", "src2", "src3")).select("source").distinct(), "source", "left_anti").select("doc_id"))
query("JOI11_rated_chunks", "SELECT doc_id, CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, sha256(text) AS text FROM documents JOIN labels USING (doc_id)")(lambda t: t.documents.join(t.labels, "doc_id").select("doc_id", F.when(c("quality") == 1, 1.0).otherwise(0.0).alias("label"), F.sha2("text", 256).alias("text")))
query(
    "FLT14_scored_strips",
    f"SELECT doc_id, i - 1 AS at, trim(s) AS strip, score FROM (SELECT doc_id, n_chars % 100 / 100.0::DOUBLE AS score, unnest({SENT}) AS s, generate_subscripts({SENT}, 1) AS i FROM documents) WHERE length(trim(s)) >= 10 AND score >= 0.3::DOUBLE",
)(
    lambda t: t.documents.select("doc_id", (c("n_chars") % 100 / 100).alias("score"), F.posexplode(T.sentences(c("text"))).alias("at", "s")).where("score >= 0.3").select("doc_id", c("at").cast("long").alias("at"), F.trim("s").alias("strip"), "score").where(F.length("strip") >= 10)
)
query(
    "AGG26_packed_chunks",
    """WITH g AS (SELECT lang || ':' || doc_id // 20 AS key, *, 'q' || doc_id AS question FROM documents WHERE text IS NOT NULL)
    SELECT key, count(*) AS n, sha256(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id)) AS hash, array_to_string(list_sort(list_distinct(list(source))), ',') AS keywords, array_to_string(list(question ORDER BY doc_id)[1:5], ',') AS questions, min(doc_id) AS first FROM g GROUP BY 1""",
)(
    lambda t: V.packed_by_key(t.documents.where("text is not null").select(F.concat(c("lang"), F.lit(":"), F.floor(c("doc_id") / 20)).alias("key"), c("doc_id").alias("position"), "text", F.array("source").alias("keywords"), F.array(F.concat(F.lit("q"), c("doc_id"))).alias("questions"))).select(
        "key", "n", "hash", F.array_join("keywords", ",").alias("keywords"), F.array_join("questions", ",").alias("questions"), "first"
    )
)
query(
    "CMP07_resolved_context",
    """WITH u AS (SELECT *, doc_id // 10 AS source_id, doc_id % 7 AS version FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r = 1),
    v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY version DESC, doc_id) AS newest FROM u) WHERE newest = 1),
    b AS (SELECT source, doc_id, sum(length(text) // 4) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS used FROM v) SELECT source, doc_id FROM b WHERE used <= 20000""",
)(lambda t: A.running(V.newest_of(V.first_of(t.documents.where("text is not null"), F.sha2("text", 256), "doc_id"), F.floor(c("doc_id") / 10), c("doc_id") % 7, "doc_id"), ["source"], [F.desc("n_chars"), c("doc_id")], {"used": F.floor(F.length("text") / 4)}).where("used <= 20000").select("source", "doc_id"))
query(
    "INC11_version_events",
    """SELECT o_custkey AS doc_id, lag(o_orderkey) OVER w AS old_version, o_orderkey AS new_version, CASE WHEN lag(o_orderkey) OVER w IS NULL THEN 'indexed' ELSE 'updated' END AS event FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
)(lambda t: V.version_events(t.orders.select(c("o_custkey").alias("doc_id"), c("o_orderkey").alias("version")), "doc_id", "version"))
