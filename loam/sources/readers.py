"""Readers of exported record families to one document shape.

Each family has a parser from a column of JSON text (so that batch files,
streams and tables share it) and the path readers use spark.read. Paths go
through Spark only, never through open().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import schemas as S

c = F.col


def document(source_id: Column, source_type: str, title: Column, content: Column, content_type: str = "text", **metadata: Column) -> list[Column]:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    meta = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return [source_id.cast("string").alias("source_id"), F.lit(source_type).alias("source_type"), title.alias("title"), content.alias("content"), F.lit(content_type).alias("content_type"), meta.alias("metadata")]


def parsed(df: DataFrame, schema: str, raw: str = "raw") -> DataFrame:
    """Rows whose JSON reads; malformed ones are left out."""
    return df.select(F.from_json(raw, schema, {"mode": "PERMISSIVE"}).alias("j")).where("j is not null")


def wiki_pages(df: DataFrame) -> DataFrame:
    p = parsed(df, S.WIKI_PAGE).where("j.id is not null").select("j.*")
    body = F.coalesce("body.storage.value", "body.view.value", F.lit(""))
    return p.select(*document(c("id"), "confluence", c("title"), T.html_text(body), "html", space=c("space.key"), version=c("version.number"), updated_at=c("version.when"), author=c("version.by.displayName")))


def issues(df: DataFrame) -> DataFrame:
    p = parsed(df, S.ISSUE).where("j.key is not null").select("j.key", "j.fields.*")
    comments = F.array_join(F.transform(F.coalesce("comment.comments", F.array()), lambda x: F.concat_ws(": ", x["author"]["displayName"], x["body"])), "\n")
    return p.select(*document(c("key"), "jira", c("summary"), F.concat_ws("\n\n", "description", F.nullif(comments, F.lit(""))), status=c("status.name"), priority=c("priority.name"), assignee=c("assignee.displayName"), updated_at=c("updated")))


def commits(df: DataFrame, most: int = 5, chars: int = 200) -> DataFrame:
    """Commits with the beginnings of their first diffs."""
    p = parsed(df, S.COMMIT).where("j.id is not null").select("j.*")
    diffs = F.array_join(F.transform(F.slice(F.coalesce("diffs", F.array()), 1, most), lambda d: F.concat_ws("\n", d["new_path"], F.substring(d["diff"], 1, chars))), "\n")
    return p.select(*document(c("id"), "gitlab_commit", c("title"), F.concat_ws("\n\n", "message", F.nullif(diffs, F.lit(""))), author=c("author_name"), created_at=c("created_at")))


def merge_requests(df: DataFrame) -> DataFrame:
    p = parsed(df, S.MERGE_REQUEST).where("j.iid is not null").select("j.*")
    notes = F.flatten(F.transform(F.coalesce("discussions", F.array()), lambda d: F.coalesce(d["notes"], F.array())))
    talk = F.array_join(F.transform(notes, lambda n: F.concat_ws(": ", n["author"], n["body"])), "\n")
    return p.select(*document(c("iid"), "gitlab_mr", c("title"), F.concat_ws("\n\n", "description", F.nullif(talk, F.lit(""))), state=c("state"), updated_at=c("updated_at")))


def code_files(df: DataFrame) -> DataFrame:
    p = parsed(df, S.CODE_FILE).where("j.path is not null").select("j.*")
    return p.select(*document(c("path"), "code", F.element_at(F.split("path", "/"), -1), F.coalesce("content", F.lit("")), "code", language=c("language")))


FAMILIES = {"confluence": wiki_pages, "jira": issues, "commits": commits, "merge_requests": merge_requests, "code": code_files}


def collect_documents(spark: SparkSession, folder: str, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """Documents of every family under folder/family, one JSON record a line."""
    out = None
    for family in families:
        docs = FAMILIES[family](spark.read.text(f"{folder}/{family}", recursiveFileLookup=True).withColumnRenamed("value", "raw"))
        out = docs if out is None else out.unionByName(docs)
    return out


def since(df: DataFrame, moment: str | None, field: str = "updated_at") -> DataFrame:
    """Documents changed after a moment (ISO text), all without one."""
    return df if moment is None else df.where(F.element_at("metadata", field) > moment)


def conversations(df: DataFrame, raw: str = "raw") -> DataFrame:
    """conversation, turn, role, text from chat exports: message lists, mappings ordered by time, or Q:/A: text."""
    j = df.select(c(raw).alias("raw"), F.from_json(raw, S.CHAT).alias("j"), F.monotonically_increasing_id().alias("conversation"))
    listed = F.transform(F.coalesce("j.messages", F.array()), lambda m: F.struct(F.coalesce(m["create_time"], F.lit(0.0)).alias("t"), m["role"].alias("role"), m["content"].alias("text")))
    mapped = F.transform(F.map_values(F.coalesce("j.mapping", F.create_map())), lambda m: F.struct(F.coalesce(m["message"]["create_time"], F.lit(0.0)).alias("t"), m["message"]["author"]["role"].alias("role"), F.array_join(m["message"]["content"]["parts"], "\n").alias("text")))
    spoken = F.transform(T.matches(c("raw"), r"(?ms)^[QA]:.*?(?=^[QA]:|\z)"), lambda m: F.struct(F.lit(0.0).alias("t"), F.when(m.startswith("Q"), "user").otherwise("assistant").alias("role"), F.trim(F.regexp_replace(F.substring(m, 3, 1_000_000), r"\s+$", "")).alias("text")))
    turns = F.when(F.size(listed) > 0, listed).when(F.size(mapped) > 0, F.array_sort(mapped)).otherwise(spoken)
    return j.select("conversation", F.posexplode(turns).alias("turn", "m")).select("conversation", "turn", "m.role", "m.text").where("role is not null and text is not null")


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """query and relevant_docs from JSON lines or arrays; comments, blank and malformed lines are skipped."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    rows = lines.select(F.from_json(F.when(F.trim("value").startswith("["), c("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]"))), f"array<struct<{_struct(S.EVAL)}>>").alias("x"))
    return rows.select(F.explode("x").alias("x")).select("x.*").where("query is not null and relevant_docs is not null")


def _struct(ddl: str) -> str:
    return ",".join(f"{part.strip().split(' ', 1)[0]}:{part.strip().split(' ', 1)[1]}" for part in ddl.split(", "))


def log(spark: SparkSession, path: str, schema: str = S.AUDIT, latest: int | None = None, order: str = "timestamp") -> DataFrame:
    """Rows of an append-only JSON log, malformed lines skipped; with latest, the newest ones."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if latest is None else df.orderBy(F.desc(order)).limit(latest)


def markup_sections(df: DataFrame, kind: Column, text: str = "text") -> DataFrame:
    """Section counts, code blocks and links of Markdown, RST or AsciiDoc texts."""
    t = c(text)
    heads = F.when(kind == "rst", F.regexp_count(t, F.lit(r"(?m)^[=\-~^]{3,}\s*$"))).when(kind == "asciidoc", F.regexp_count(t, F.lit(r"(?m)^=+\s+\S"))).otherwise(F.regexp_count(t, F.lit(r"(?m)^#{1,6}\s+\S")))
    return df.withColumn("headings", heads).withColumn("code_blocks", T.matches(t, r"(?s)```.*?```|----\n.*?\n----")).withColumn("links", T.matches(t, r"\[[^\]]+\]\(([^)]+)\)|`[^`<]*<([^>]+)>`_", 1))


def images(df: DataFrame, html: str = "html") -> DataFrame:
    """src and alt of each image tag; recognising what an image shows needs a model and is left to a plug-in."""
    tags = df.withColumn("tag", F.explode(T.matches(c(html), r"(?is)<img[^>]*>")))
    return tags.withColumn("src", F.regexp_extract("tag", r"""(?i)src=["']([^"']*)["']""", 1)).withColumn("alt", F.regexp_extract("tag", r"""(?i)alt=["']([^"']*)["']""", 1)).drop("tag", html)


def image_records(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key, images, captioned, coverage: images of each page, how many have a caption, and that share (0 without images)."""
    tags = df.select(key, T.matches(c(html), r"(?is)<img[^>]*>").alias("tags"))
    counted = tags.select(key, F.size("tags").alias("images"), F.size(F.filter("tags", lambda x: F.trim(F.regexp_extract(x, r"""(?is)\balt=["']([^"']*)["']""", 1)) != "")).alias("captioned"))
    return counted.select(key, c("images").cast("long").alias("images"), c("captioned").cast("long").alias("captioned"), F.round(F.coalesce(F.try_divide("captioned", "images"), F.lit(0.0)), 6).alias("coverage"))
