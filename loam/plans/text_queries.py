"""Queries of the text functions over documents and pages (FUN rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import Tables, query

c = F.col

# SQL pieces, written for DuckDB
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SENTENCES = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
PIECES = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
BPE = r"CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) * 1.3::DOUBLE)::BIGINT) END"


def docs(name: str, sql: str, **columns):
    """Register a query that computes columns for each document."""
    query(name, f"SELECT doc_id, {sql} FROM documents")(lambda t: t.documents.select("doc_id", *[v().alias(k) for k, v in columns.items()]))


docs(
    "FUN01_script_tokens",
    r"""CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(
        len(regexp_extract_all(text, '[\x{0400}-\x{052F}]')) / 3.0::DOUBLE + len(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{024F}]')) / 4.0::DOUBLE
        + len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]')) / 1.5::DOUBLE
        + (length(text) - len(regexp_extract_all(text, '[\x{0400}-\x{052F}A-Za-z\x{00C0}-\x{024F}\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]'))) / 4.0::DOUBLE)::BIGINT) END AS tokens""",
    tokens=lambda: T.script_tokens(c("text")),
)
docs("FUN02_quarter_tokens", "(length(text) // 4)::BIGINT AS tokens", tokens=lambda: T.quarter_tokens(c("text")))
docs("FUN03_bpe_tokens", f"{BPE} AS tokens", tokens=lambda: T.bpe_tokens(c("text")))
docs(
    "FUN04_token_cost",
    f"CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(greatest(1, length(text) // 4) * 0.4::DOUBLE + ({BPE}) * 0.6::DOUBLE)::BIGINT) END AS cost",
    cost=lambda: T.token_cost(c("text")),
)
docs("FUN05_truncated", "CASE WHEN length(text) <= 200 THEN text ELSE left(text, 200) || '...' END AS short", short=lambda: T.truncated(c("text"), 50))
docs(
    "FUN07_chunk_hash",
    "sha256(concat_ws('|', coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''), '1', '')) AS hash",
    hash=lambda: F.sha2(F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in (c("text"), c("lang"), c("source"), F.lit("1"), F.lit(""))]), 256),
)
docs("FUN08_sha256", "sha256(text) AS hash", hash=lambda: F.sha2(c("text"), 256))
docs("FUN09_sentences", f"len({SENTENCES})::BIGINT AS n, ({SENTENCES})[1] AS first", n=lambda: F.size(T.sentences(c("text"))).cast("long"), first=lambda: T.sentences(c("text"))[0])
CLAIMS = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), '\n|;\s+', chr(1), 'g'), chr(1)),
    lambda p: trim(regexp_replace(regexp_replace(trim(p), '[;.]+$', ''), '^[-*•]\s*', ''))), lambda x: length(x) >= 10)"""
docs("FUN10_claims", f"len({CLAIMS})::BIGINT AS n, array_to_string({CLAIMS}, '¦') AS claims", n=lambda: F.size(T.claims(c("text"))).cast("long"), claims=lambda: F.array_join(T.claims(c("text")), "¦"))
docs(
    "FUN11_paragraphs",
    r"len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''))::BIGINT AS n",
    n=lambda: F.size(T.paragraphs(c("text"))).cast("long"),
)
STOP = "и в на с к у по для из о не быть что как это".split()


def keywords(t: Tables, least: int, most: int, tie: str):
    """Most frequent words of each document, ties by first place or by word."""
    w = t.documents.select("doc_id", F.posexplode(T.words(c("text"))).alias("pos", "word")).where(F.length("word") >= least).where(~c("word").isin(STOP))
    from pyspark.sql import Window

    counted = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), tie, "word"))
    return counted.withColumn("rank", rank.cast("long")).where(c("rank") <= most).select("doc_id", "word", "n", "rank")


def keywords_sql(least: int, most: int, tie: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    return f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) AS pos FROM documents),
        k AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM w WHERE length(word) >= {least} AND word NOT IN ({stop}) GROUP BY ALL),
        r AS (SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, {tie}, word) AS rank FROM k)
        SELECT doc_id, word, n, rank FROM r WHERE rank <= {most}"""


query("FUN12_keywords", keywords_sql(4, 5, "pos"))(lambda t: keywords(t, 4, 5, "pos"))
query("FUN13_heuristic_keywords", keywords_sql(3, 8, "word"))(lambda t: keywords(t, 3, 8, "word"))
query("FUN14_entities")(lambda t: t.documents.select("doc_id", F.array_join(T.entities(c("text")), "|").alias("entities")))
query(
    "FUN15_summary",
    r"""WITH k AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '^\[[^\n]*?\]\s*', ''), '(?m)^#{1,6}\s+', '', 'g') AS k FROM documents),
    s AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(k, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)) AS s FROM k),
    b AS (SELECT doc_id, text, trim(CASE WHEN len(s) < 2 OR length(s[1]) + 1 >= 150 THEN s[1] ELSE s[1] || ' ' || s[2] END) AS b FROM s)
    SELECT doc_id, CASE WHEN trim(text) = '' THEN '' WHEN length(text) > length(b) AND NOT ends_with(b, '...') AND length(b) >= 147 THEN rtrim(left(b, 147)) || '...' ELSE b END AS summary FROM b""",
)(lambda t: t.documents.select("doc_id", T.summary(c("text")).alias("summary")))
docs(
    "FUN16_two_sentences",
    f"CASE WHEN len({SENTENCES}) <= 2 THEN text ELSE array_to_string(({SENTENCES})[1:2], ' ') || '...' END AS summary",
    summary=lambda: T.two_sentences(c("text")),
)
query("FUN17_question_mining", r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[^.!?\n]{10,199}\?'), lambda q: length(q) > 10)[1:3], '|') AS questions FROM documents")(lambda t: t.documents.select("doc_id", F.array_join(F.slice(F.filter(T.matches(c("text"), r"[^.!?\n]{10,199}\?"), lambda q: F.length(q) > 10), 1, 3), "|").alias("questions")))
Q18 = "concat(CASE doc_id % 5 WHEN 0 THEN 'as of 2024-03-0' || (doc_id % 9 + 1) WHEN 1 THEN 'see v' || (doc_id % 7) || '.' || (doc_id % 10) WHEN 2 THEN 'version ' || doc_id % 3 || '.4.1 of' WHEN 3 THEN 'version=' || doc_id || '.0' ELSE 'no number' END, ' ', left(text, 20))"
query(
    "FUN18_query_version",
    rf"""WITH q AS (SELECT doc_id, {Q18} AS q FROM documents)
    SELECT doc_id, coalesce(nullif(regexp_extract(q, '(?i)(?:v|version)[\s]*(\d+(?:\.\d+)+(?:\.\d+)?)', 1), ''), nullif(regexp_extract(q, '(?i)version[\s]*[=:][\s]*(\d+(?:\.\d+)+)', 1), ''),
        nullif(regexp_extract(q, '(\d{{4}}-\d{{2}}-\d{{2}})', 1), '')) AS version FROM q""",
)(lambda t: t.documents.select("doc_id", T.query_version(F.expr(Q18.replace("left(text, 20)", "substring(text, 1, 20)"))).alias("version")))
docs(
    "FUN19_metadata_filters",
    r"""nullif(regexp_extract(text, '(?i)version\s*[:=]?\s*(\S+)', 1), '') AS version,
    nullif(regexp_extract(text, '(\d{4}-\d{2}-\d{2})', 1), '') AS date,
    nullif(regexp_extract(text, '(?i)(specification|guide|tutorial|reference|manual)', 1), '') AS type""",
    version=lambda: F.nullif(F.regexp_extract("text", r"(?i)version\s*[:=]?\s*(\S+)", 1), F.lit("")),
    date=lambda: F.nullif(F.regexp_extract("text", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")),
    type=lambda: F.nullif(F.regexp_extract("text", "(?i)(specification|guide|tutorial|reference|manual)", 1), F.lit("")),
)
docs(
    "FUN20_decomposed",
    r"len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '[^\x00-\x7F]', 'z', 'g'), '(?i)\band\b|;|\balso\b|\bplus\b'), lambda p: trim(p)), lambda p: p <> ''))::BIGINT AS parts",
    parts=lambda: F.size(F.filter(F.transform(F.split("text", r"(?i)\band\b|;|\balso\b|\bplus\b"), lambda x: F.trim(x)), lambda p: p != "")).cast("long"),
)


def variants(text):
    """The query, an explanation of it, its longer words, a question and a definition."""
    low = F.lower(text)
    keep = F.array_join(F.filter(T.pieces(text), lambda w: F.length(w) > 2), " ")
    asks = low.rlike("^(what|how|why|when|where|who|which)")
    return F.slice(F.array_compact(F.array(text, F.when(~asks, F.concat(F.lit("explain "), text)), F.when(keep != "", keep), F.concat(text, F.lit("?")), F.concat(F.lit("what is "), text))), 1, 4)


query(
    "FUN21_query_variants",
    r"""WITH k AS (SELECT item_id, text, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 2), ' ') AS keep FROM benchmark)
    SELECT item_id, array_to_string(list_filter([text, CASE WHEN NOT regexp_matches(lower(text), '^(what|how|why|when|where|who|which)') THEN 'explain ' || text END, CASE WHEN keep <> '' THEN keep END, text || '?', 'what is ' || text], lambda x: x IS NOT NULL)[1:4], '|') AS variants FROM k""",
)(lambda t: t.benchmark.select("item_id", F.array_join(variants(c("text")), "|").alias("variants")))
SYL = r"list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: greatest(1, len(regexp_extract_all(regexp_replace(lower(w), 'e$', ''), '[aeiouy]+')))))"
GRADE = rf"""CASE WHEN len(regexp_extract_all(text, '[A-Za-z]+')) = 0 THEN 0.0::DOUBLE ELSE
    0.39::DOUBLE * (len(regexp_extract_all(text, '[A-Za-z]+'))::DOUBLE / greatest(1, len(regexp_extract_all(text, '[.!?]+')))) + 11.8::DOUBLE * ({SYL}::DOUBLE / len(regexp_extract_all(text, '[A-Za-z]+'))) - 15.59::DOUBLE END"""
docs("FUN22_reading_grade", f"round({GRADE}, 6) AS grade", grade=lambda: F.round(T.reading_grade(c("text")), 6))


def boosts(table: dict, sign: int) -> str:
    return " ".join(f"+ CASE WHEN contains(lower(trim(text)), '{p}') THEN {sign * w} ELSE 0 END" for p, w in table.items())


COMPLEXITY = f"""greatest(1, least(10, CASE WHEN len({PIECES}) <= 2 THEN 1 WHEN len({PIECES}) <= 5 THEN 3 WHEN len({PIECES}) <= 10 THEN 5 WHEN len({PIECES}) <= 18 THEN 7 ELSE 9 END
    {boosts(T.COMPLEX, 1)} {boosts(T.SIMPLE, -1)}
    + CASE WHEN len(regexp_extract_all(text, '\\?')) > 1 THEN 2 WHEN len(regexp_extract_all(text, '\\?')) = 1 AND len({PIECES}) > 8 THEN 1 ELSE 0 END
    + CASE WHEN ({GRADE}) > 12 THEN 2 WHEN ({GRADE}) > 8 THEN 1 ELSE 0 END))::BIGINT"""
query("FUN23_complexity", f"SELECT item_id, {COMPLEXITY} AS score FROM benchmark")(
    lambda t: t.benchmark.select("item_id", T.complexity(c("text")).cast("long").alias("score"))
)
PLAIN = f"""greatest(1, least(10, CASE WHEN len({PIECES}) <= 3 THEN 1 WHEN len({PIECES}) <= 6 THEN 3 WHEN len({PIECES}) <= 12 THEN 5 WHEN len({PIECES}) <= 20 THEN 7 ELSE 9 END
    + least(3, {' + '.join(f"contains(lower(text), '{w}')::INT" for w in T.COMPARISONS)})
    + (len(regexp_extract_all(text, '\\?')) > 1 OR (len(regexp_extract_all(text, '\\?')) = 1 AND len({PIECES}) > 10))::INT))::BIGINT"""
docs("FUN24_plain_complexity", f"{PLAIN} AS score", score=lambda: T.plain_complexity(c("text")).cast("long"))
docs(
    "FUN25_masked_pii",
    r"""sha256(regexp_replace(regexp_replace(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '[EMAIL]', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b', '[IP]', 'g'), '\b[A-Za-z0-9_-]{32,}\b', '[REDACTED]', 'g')) AS hash""",
    hash=lambda: F.sha2(T.masked_pii(c("text")), 256),
)
docs(
    "FUN26_masked_tokens",
    r"sha256(replace(regexp_replace(text, '\b[A-Za-z0-9]{40,}\b', '[REDACTED_TOKEN]', 'g'), 'password', '[REDACTED]')) AS hash",
    hash=lambda: F.sha2(T.masked_tokens(c("text"), ("password",)), 256),
)
query("FUN27_clean_query", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(left(html, 8000), '<[^>]*>', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'))) AS hash FROM pages")(
    lambda t: t.pages.select("page_id", F.sha2(T.clean_query(c("html")), 256).alias("hash"))
)
flag = lambda patterns, name, col: " || ',' || ".join(f"CASE WHEN regexp_matches({col}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{name}_pattern_{i}' ELSE '' END" for i, p in enumerate(patterns))
query("FUN28_injections", f"SELECT page_id, array_to_string(list_filter(string_split({flag(T.SQLI, 'sqli', 'html')}, ','), lambda x: x <> ''), ',') AS sqli, array_to_string(list_filter(string_split({flag(T.XSS, 'xss', 'html')}, ','), lambda x: x <> ''), ',') AS xss FROM pages")(
    lambda t: t.pages.select("page_id", F.array_join(T.detected(c("html"), T.SQLI, "sqli"), ",").alias("sqli"), F.array_join(T.detected(c("html"), T.XSS, "xss"), ",").alias("xss"))
)
docs(
    "FUN29_keys_urls",
    r"""array_to_string(regexp_extract_all(text, '\b[A-Z][A-Z0-9]+-\d+\b'), ' ') AS keys, array_to_string(regexp_extract_all(text, 'https?://[^\s<>"'']+'), ' ') AS urls""",
    keys=lambda: F.array_join(T.issue_keys(c("text")), " "),
    urls=lambda: F.array_join(T.urls(c("text")), " "),
)
TEXT_OF_HTML = r"""array_to_string(list_filter(list_transform(regexp_split_to_array(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'),
    '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '\r\n|\n|\r'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))"""
query("FUN30_html_text", f"SELECT page_id, {TEXT_OF_HTML} AS text FROM pages")(lambda t: t.pages.select("page_id", T.html_text(c("html")).alias("text")))
query(
    "FUN31_html_headings",
    r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-3][^>]*>.*?</h[1-3]>')) AS h FROM pages)
    SELECT page_id, substr(h, 3, 1)::INT AS level, trim(regexp_replace(h, '(?s)<[^>]*>', '', 'g')) AS heading FROM h""",
)(lambda t: t.pages.select("page_id", F.explode(T.html_headings(c("html"))).alias("h")).select("page_id", "h.level", c("h.text").alias("heading")))
query("FUN36_html_links", """SELECT page_id, link, link LIKE 'http%' AS external FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)""")(
    lambda t: t.pages.select("page_id", F.explode(T.html_links(c("html"))).alias("link")).withColumn("external", c("link").startswith("http"))
)
docs(
    "FUN37_context_prefix",
    "'Document: doc' || doc_id || ' | Source: ' || source || chr(10) || chr(10) || text AS text",
    text=lambda: F.concat(F.concat_ws(" | ", F.concat(F.lit("Document: doc"), c("doc_id")), F.concat(F.lit("Source: "), c("source"))), F.lit("\n\n"), "text"),
)
docs(
    "FUN38_chunk_header",
    "concat_ws(' ', '[Type: ' || source || ']', CASE WHEN doc_id % 2 = 0 THEN '[Doc: d' || doc_id || ']' END, '[Version: ' || lang || ']') AS header",
    header=lambda: T.header(Type=c("source"), Doc=F.when(c("doc_id") % 2 == 0, F.concat(F.lit("d"), c("doc_id"))), Section=F.lit(""), Version=c("lang")),
)
query("FUN39_timestamps", "SELECT event_id, epoch_us(ts) AS micros, epoch_us(strftime(ts, '%Y-%m-%d %H:%M:%S')::TIMESTAMP) AS parsed FROM events")(
    lambda t: t.events.select(
        "event_id",
        F.unix_micros(c("ts").cast("timestamp")).alias("micros"),
        F.unix_micros(F.try_to_timestamp(F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))).alias("parsed"),
    )
)


def moment(text: str):
    return F.lit(text).cast("timestamp")


query("FUN40_time_decay", "SELECT event_id, round(value * (1 + exp(-greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(ts)) / 86400e6::DOUBLE) / 180.0::DOUBLE)), 6) AS score FROM events")(
    lambda t: t.events.select("event_id", F.round(T.decayed(c("value"), c("ts"), moment("2024-06-01 00:00:00")), 6).alias("score"))
)
STALE = """round(coalesce(least(100.0::DOUBLE, greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 86400e6::DOUBLE) / CASE event_type WHEN 'click' THEN 90 WHEN 'view' THEN 30 ELSE 180 END * 100), 50.0::DOUBLE), 6)"""
stale = lambda: F.round(T.staleness(c("ts"), moment("2024-03-01 00:00:00"), F.when(c("event_type") == "click", "chat").when(c("event_type") == "view", "jira").otherwise("other")), 6)
query("FUN41_staleness", f"SELECT event_id, {STALE} AS staleness FROM events")(lambda t: t.events.select("event_id", stale().alias("staleness")))
query("FUN42_stale_listing", f"SELECT event_id, {STALE} AS staleness FROM events WHERE {STALE} >= 50")(lambda t: t.events.select("event_id", stale().alias("staleness")).where("staleness >= 50").orderBy(F.desc("staleness"), "event_id"))
docs(
    "FUN43_coherence",
    f"""round(CASE WHEN text = '' THEN 0.0::DOUBLE WHEN len({PIECES}) < 5 THEN len({PIECES}) / 5.0::DOUBLE * 0.1::DOUBLE WHEN len({PIECES}) > 2000 THEN 0.5::DOUBLE ELSE
    least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN len({PIECES}) BETWEEN 50 AND 800 THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN list_unique(list_transform({PIECES}, lambda x: lower(x))) / len({PIECES})::DOUBLE > 0.6 THEN 0.15::DOUBLE WHEN list_unique(list_transform({PIECES}, lambda x: lower(x))) / len({PIECES})::DOUBLE > 0.3 THEN 0.1::DOUBLE ELSE 0 END
    + CASE WHEN source = 'src1' THEN 0.1::DOUBLE ELSE 0 END) END, 6) AS coherence""",
    coherence=lambda: F.round(T.coherence(c("text"), c("source") == "src1"), 6),
)


def budget(n):
    """Tokens for system prompt, history, response, all context and each chunk, for n available."""
    system, response, history = F.least(F.lit(2000), n / 10), F.least(F.lit(4096), n / 5), F.least(F.lit(8000), n / 6)
    whole = lambda x: F.floor(x).cast("long")
    return [F.when(n < 1000, a).otherwise(b).alias(k) for k, a, b in (
        ("system_prompt", F.greatest(F.lit(50), whole(n / 5)), whole(system)),
        ("context_total", F.greatest(F.lit(100), whole(n * 3 / 5)), n - whole(system) - whole(response) - whole(history)),
        ("history", F.lit(0), whole(history)),
        ("response", F.greatest(F.lit(50), whole(n / 5)), whole(response)),
    )]


query(
    "FUN44_token_budget",
    """SELECT doc_id, CASE WHEN n < 1000 THEN greatest(50, n // 5) ELSE least(2000, n // 10) END::BIGINT AS system_prompt,
    CASE WHEN n < 1000 THEN greatest(100, n * 3 // 5) ELSE n - least(2000, n // 10) - least(4096, n // 5) - least(8000, n // 6) END::BIGINT AS context_total,
    CASE WHEN n < 1000 THEN 0 ELSE least(8000, n // 6) END::BIGINT AS history, CASE WHEN n < 1000 THEN greatest(50, n // 5) ELSE least(4096, n // 5) END::BIGINT AS response
    FROM (SELECT doc_id, n_chars AS n FROM documents)""",
)(lambda t: t.documents.select("doc_id", *[x.cast("long").alias(n) for x, n in zip(budget(c("n_chars")), ("system_prompt", "context_total", "history", "response"), strict=True)]))


def letters(chars: str) -> str:
    return f"len(regexp_extract_all(text, '[{chars}]'))"


common = lambda table: f"len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')), [{', '.join(repr(w) for w in table)}]))"
LANGUAGE = f"""CASE WHEN de + 3 * dw >= 2 AND de + 3 * dw > fr + 3 * fw THEN 'de' WHEN fr + 3 * fw >= 2 AND fr + 3 * fw > de + 3 * dw THEN 'fr'
    WHEN de > 0 AND de >= al * 0.03::DOUBLE THEN 'de' WHEN fr > 0 AND fr >= al * 0.03::DOUBLE THEN 'fr' ELSE 'en' END"""
LANG_CTE = f"WITH l AS (SELECT doc_id, text, {letters(T.GERMAN_LETTERS)} AS de, {letters(T.FRENCH_LETTERS)} AS fr, {letters(chr(92) + 'p{L}')} AS al, {common(T.GERMAN_WORDS)} AS dw, {common(T.FRENCH_WORDS)} AS fw FROM documents), g AS (SELECT doc_id, text, {LANGUAGE} AS lang FROM l)"
query("FUN49_language", f"{LANG_CTE} SELECT doc_id, lang AS detected FROM g")(lambda t: t.documents.select("doc_id", T.language(c("text")).alias("detected")))
has = lambda table: "(" + " OR ".join(f"lang = '{k}' AND contains(lower(text), '{w}')" for k, ws in table.items() for w in ws) + ")"
INTENT = f"CASE WHEN lang IN ('de', 'fr', 'zh') THEN CASE WHEN {has(T.GREETINGS)} THEN 'greeting' WHEN {has(T.COMPARE)} THEN 'comparison' WHEN {has(T.HOW_TO)} THEN 'procedural' ELSE 'factual' END END"
intents = lambda t: t.documents.select("doc_id", "text", T.language(c("text")).alias("lang")).withColumn("intent", T.intent(c("text"), c("lang")))
query("FUN45_intent", f"{LANG_CTE} SELECT doc_id, {INTENT} AS intent FROM g")(lambda t: intents(t).select("doc_id", "intent"))
query("FUN46_graph_use", f"{LANG_CTE} SELECT doc_id, coalesce({INTENT} = 'comparison', false) OR " + " OR ".join(f"contains(lower(text), '{w}')" for w in T.RELATIONS) + " AS graph FROM g")(
    lambda t: intents(t).select("doc_id", T.wants_graph(c("text"), c("intent")).alias("graph"))
)
QUESTION = """CASE c_custkey % 6 WHEN 0 THEN 'What projects does ' || c_name || ' work on' WHEN 1 THEN 'who worked on ' || lower(c_name) WHEN 2 THEN 'What tickets are related to c' || c_custkey || '?'
    WHEN 3 THEN 'What dependencies does ' || c_name || ' have?' WHEN 4 THEN 'How is The ' || c_name || ' doing' ELSE 'nothing to see in ' || c_custkey END"""
GRAPH_SQL = " ".join(
    f"WHEN regexp_matches(lower(q), '{p}') THEN replace('{s.replace(chr(39), chr(39) * 2)}', '{{entity}}', upper(regexp_extract(lower(q), '{p}', 1)[1]) || regexp_extract(lower(q), '{p}', 1)[2:])" for p, s in T.GRAPH_QUESTIONS
)
query(
    "FUN47_cypher_templates",
    rf"""WITH k AS (SELECT c_custkey, {QUESTION} AS q FROM customer), n AS (SELECT c_custkey, q, list_filter(string_split(q, ' '), lambda w: regexp_matches(w, '^\p{{Lu}}') AND length(w) > 2 AND w NOT IN ({", ".join(map(repr, T.NO_ENTITY))})) AS named FROM k)
    SELECT c_custkey, CASE {GRAPH_SQL} WHEN len(named) > 0 THEN replace('{T.ANY_NODE.replace(chr(39), chr(39) * 2)}', '{{entity}}', named[1]) END AS cypher FROM n""",
)(lambda t: t.customer.select("c_custkey", T.graph_statement(F.expr(QUESTION)).alias("cypher")))
query("FUN48_safe_divide", "SELECT event_id, round(coalesce(value / nullif(user_id % 7, 0), 0.0::DOUBLE), 6) AS ratio, (event_id // 100)::BIGINT AS batch, 'type: ' || event_type || ' | user: ' || user_id AS meta FROM events")(
    lambda t: t.events.select(
        "event_id",
        F.round(F.coalesce(F.try_divide("value", c("user_id") % 7), F.lit(0.0)), 6).alias("ratio"),
        F.floor(c("event_id") / 100).alias("batch"),
        F.concat_ws(" | ", F.concat(F.lit("type: "), c("event_type")), F.concat(F.lit("user: "), c("user_id"))).alias("meta"),
    )
)
#: Departments by key prefix.
DEPARTMENTS = {"ENG": "engineering", "DEV": "engineering", "FE": "engineering", "BE": "engineering", "HR": "hr", "FIN": "finance", "MKT": "marketing", "OPS": "operations", "SEC": "security", "QA": "quality", "PM": "product", "DES": "design", "INFRA": "infrastructure", "DATA": "data", "SRE": "sre", "LEGAL": "legal", "SUP": "support"}
DEPT_KEYS = [*DEPARTMENTS, "XYZ", ""]


def department(key, default: str):
    table = F.create_map(*[F.lit(x) for kv in DEPARTMENTS.items() for x in kv])
    return F.coalesce(F.element_at(table, F.upper(F.split_part(key, F.lit("-"), F.lit(1)))), F.lit(default))


query(
    "FUN50_department",
    f"SELECT n_nationkey, CASE upper(split_part(k, '-', 1)) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in DEPARTMENTS.items())} ELSE 'general' END AS space, CASE upper(split_part(k, '-', 1)) {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in DEPARTMENTS.items())} ELSE '' END AS project FROM (SELECT n_nationkey, ([{', '.join(map(repr, DEPT_KEYS))}])[(n_nationkey % {len(DEPT_KEYS)} + 1)::INT] || '-1' AS k FROM nation)",
)(
    lambda t: t.nation.select("n_nationkey", F.concat(F.element_at(F.array(*map(F.lit, DEPT_KEYS)), (c("n_nationkey") % len(DEPT_KEYS) + 1).cast("int")), F.lit("-1")).alias("k")).select(
        "n_nationkey", department(c("k"), "general").alias("space"), department(c("k"), "").alias("project")
    )
)
MARKDOWN = r"""regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<img[^>]*>', '', 'g')"""
for level in range(1, 7):
    MARKDOWN = rf"regexp_replace({MARKDOWN}, '(?is)<h{level}[^>]*>(.*?)</h{level}>', chr(10) || '{'#' * level} \1' || chr(10) || chr(10), 'g')"
MARKDOWN = rf"""regexp_replace(regexp_replace({MARKDOWN}, '(?is)<li[^>]*>(.*?)</li>', '- \1' || chr(10), 'g'), '(?is)<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', '[\2](\1)', 'g')"""
MARKDOWN = rf"trim(regexp_replace(regexp_replace(regexp_replace({MARKDOWN}, '(?is)</p>|<br\s*/?>', chr(10) || chr(10), 'g'), '<[^>]+>', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'))"
query("FUN51_html_markdown", f"SELECT page_id, {MARKDOWN} AS markdown FROM pages")(lambda t: t.pages.select("page_id", T.html_markdown(c("html")).alias("markdown")))
docs(
    "FUN35_rst_asciidoc",
    r"""sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\.\. .*$', '', 'g'), ':[a-z]+:`([^`]*)`', '\1', 'g'), '(?m)^[=\-~^"''*+#]{3,}\s*$', '', 'g'), '``?([^`]*)``?', '\1', 'g'))) AS rst,
    sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^:[^:]+:.*$', '', 'g'), '(?m)^(----|====|\.\.\.\.)\s*$', '', 'g'), '(?m)^=+\s+', '', 'g'))) AS asciidoc""",
    rst=lambda: F.sha2(T.rst_text(c("text")), 256),
    asciidoc=lambda: F.sha2(T.asciidoc_text(c("text")), 256),
)
query("FUN54_status_names", "SELECT n_nationkey, CASE s WHEN 'grounded' THEN 'sufficient' WHEN 'no_knowledge' THEN 'absent' ELSE s END AS status FROM (SELECT n_nationkey, (['grounded', 'no_knowledge', 'partial', 'insufficient'])[(n_nationkey % 4 + 1)::INT] AS s FROM nation)")(
    lambda t: t.nation.select("n_nationkey", F.element_at(F.array(*map(F.lit, ("grounded", "no_knowledge", "partial", "insufficient"))), (c("n_nationkey") % 4 + 1).cast("int")).alias("s")).select(
        "n_nationkey", F.when(c("s") == "grounded", "sufficient").when(c("s") == "no_knowledge", "absent").otherwise(c("s")).alias("status")
    )
)
REPHRASE, NARROW, SPLIT = "Could you rephrase your question with more specific technical terms or product names?", "Could you clarify what specific aspect of this topic you are interested in?", "Would you like to break this down into smaller, more focused questions?"
query(
    "FUN55_clarifications",
    f"""SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '{REPHRASE}' || CASE WHEN len({PIECES}) > 10 THEN ' / {SPLIT}' ELSE '' END WHEN item_id % 3 = 1 THEN '{NARROW}' ELSE '' END AS questions FROM benchmark""",
)(
    lambda t: t.benchmark.select(
        "item_id",
        F.when(c("item_id") % 3 == 0, F.concat_ws(" / ", F.lit(REPHRASE), F.when(F.size(T.pieces(c("text"))) > 10, SPLIT))).when(c("item_id") % 3 == 1, NARROW).otherwise("").alias("questions"),
    )
)
HYDE = "Here is the answer to the query: The document that answers this question contains: According to the documentation,"
query("FUN57_hyde", f"SELECT item_id, '{HYDE} ' || text AS hyde FROM benchmark")(lambda t: t.benchmark.select("item_id", F.concat(F.lit(HYDE + " "), c("text")).alias("hyde")))
query("FUN60_canary_phase", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 <= 0 THEN 'idle' WHEN l_discount * 10 < 0.05::DOUBLE THEN 'ramp_5' WHEN l_discount * 10 < 0.25::DOUBLE THEN 'ramp_25' WHEN l_discount * 10 < 0.5::DOUBLE THEN 'ramp_50' WHEN l_discount * 10 < 0.75::DOUBLE THEN 'ramp_75' ELSE 'full' END AS phase FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", (c("l_discount") * 10).alias("p")).select(
        "l_orderkey", "l_linenumber", F.when(c("p") <= 0, "idle").when(c("p") < 0.05, "ramp_5").when(c("p") < 0.25, "ramp_25").when(c("p") < 0.5, "ramp_50").when(c("p") < 0.75, "ramp_75").otherwise("full").alias("phase")
    )
)
RU_WHOLE = "CASE doc_id % 3 WHEN 0 THEN 'Как работает поиск ' || doc_id || '. Что такое ранг?' WHEN 1 THEN 'Почему ' || text ELSE text END"
query(
    "FUN61_questions",
    rf"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(q, '(Как|Что такое|Почему|Зачем|Где)([^.!?]+)'), lambda x: trim(x) || '?'), lambda x: length(x) < 100)[1:3], '¦') AS questions FROM (SELECT doc_id, {RU_WHOLE} AS q FROM documents)""",
)(lambda t: t.documents.select("doc_id", F.array_join(T.questions(F.expr(RU_WHOLE)), "¦").alias("questions")))

# ---- filters on text

REASON = rf"""CASE WHEN {' OR '.join(f"regexp_matches(s, '{p}')" for p in T.MINIMAL)} THEN 'minimal_or_empty_content' WHEN length(s) < 20 THEN 'too_short_' || length(s) || '_chars'
    WHEN len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) < 3 THEN 'too_few_words_' || len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> ''))
    {' '.join(f"WHEN regexp_matches(s, '(?i){p}') THEN 'boilerplate_pattern_{p[:40]}'" for p in T.BOILERPLATE)} ELSE '' END"""
REASON_FROM = r"(SELECT doc_id, source, lang, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)"
query("FLT08_boilerplate", f"SELECT doc_id, {REASON} AS reason FROM {REASON_FROM}")(lambda t: t.documents.select("doc_id", T.boilerplate_reason(c("text")).alias("reason")))
query(
    "FLT09_chunk_quality",
    rf"""WITH r AS (SELECT source, {REASON} AS reason, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM {REASON_FROM}),
    s AS (SELECT source, reason, 0.6::DOUBLE * coalesce(len(list_intersect(w, ['the', 'de', 'und'])) / nullif(len(list_distinct(list_concat(w, ['the', 'de', 'und']))), 0)::DOUBLE, 0) + 0.4::DOUBLE * (len(list_intersect(w, ['the'])) / 1.0::DOUBLE) AS score FROM r)
    SELECT source, count(*) AS total, count(*) FILTER (reason = '' AND score >= 0.2::DOUBLE) AS kept, count(*) FILTER (reason <> '') AS boilerplate FROM s GROUP BY source""",
)(
    lambda t: t.documents.select("source", T.boilerplate_reason(c("text")).alias("reason"), T.word_set(c("text")).alias("w"))
    .withColumn("score", F.lit(0.6) * T.jaccard(c("w"), F.array(F.lit("the"), F.lit("de"), F.lit("und"))) + F.lit(0.4) * T.containment(F.array(F.lit("the")), c("w")))
    .groupBy("source")
    .agg(F.count("*").alias("total"), F.count_if((c("reason") == "") & (c("score") >= 0.2)).alias("kept"), F.count_if(c("reason") != "").alias("boilerplate"))
)
ASKED_AS = "CASE item_id % 5 WHEN 0 THEN 'How ' || text WHEN 1 THEN 'what is ' || text WHEN 2 THEN 'why ' || text WHEN 3 THEN left(text, 30) || ' vs ' || right(text, 30) ELSE text END"
query(
    "FUN57_expansion",
    rf"""WITH q AS (SELECT item_id, {ASKED_AS} AS q FROM benchmark), k AS (SELECT *, lower(q) AS low, list_filter(regexp_split_to_array(q, '\s+'), lambda w: length(w) > 3) AS w, instr(q, ' vs ') AS spot FROM q),
    v AS (SELECT item_id, CASE WHEN starts_with(low, 'how') AND len(w) > 1 THEN [q, 'steps to ' || trim(substr(q, 5)), 'guide for ' || trim(substr(q, 5))] WHEN starts_with(low, 'what') THEN [q, 'definition of ' || trim(substr(q, 6)), 'explain ' || trim(substr(q, 6))]
        WHEN starts_with(low, 'why') THEN [q, 'reason for ' || trim(substr(q, 5)), 'cause of ' || trim(substr(q, 5))]
        WHEN spot > 0 THEN [q, 'difference between ' || trim(left(q, spot - 1)) || ' and ' || trim(substr(q, spot + 4)), 'comparison of ' || trim(left(q, spot - 1)) || ' and ' || trim(substr(q, spot + 4))]
        WHEN len(w) >= 2 THEN [q, array_to_string(w, ' '), w[1] || ' related to ' || w[2]] ELSE [q] END AS v FROM k),
    u AS (SELECT item_id, unnest(v) AS variant, generate_subscripts(v, 1) AS i FROM v)
    SELECT item_id, variant, min(i)::INT AS place FROM u GROUP BY ALL""",
)(
    lambda t: t.benchmark.select("item_id", F.explode(T.expanded(F.expr(ASKED_AS))).alias("variant"), F.expr(ASKED_AS).alias("q")).groupBy("item_id", "variant", "q").agg(F.count("*").alias("n")).select(
        "item_id", "variant", F.array_position(T.expanded(c("q")), c("variant")).cast("int").alias("place")
    )
)
PLANTED = "CASE doc_id % 5 WHEN 0 THEN 'Как это работает сегодня вечером? Почему бы и нет, право слово. ' || text WHEN 1 THEN 'How does it work on most days? Can it? ' || text ELSE text END"
TITLES = "SELECT doc_id, " + PLANTED + " AS text, CASE WHEN doc_id % 5 <> 3 THEN 'doc ' || doc_id ELSE '' END AS title, CASE WHEN doc_id % 2 = 0 THEN 'part ' || doc_id % 3 ELSE '' END AS section, CASE doc_id % 4 WHEN 0 THEN 'jira' WHEN 1 THEN 'confluence' WHEN 2 THEN 'git' ELSE '' END AS kind FROM documents"


def phrase_sql(words: list[str], end: str) -> str:
    found = ", ".join(rf"regexp_extract_all(text, '({w}\s[^.!?]+{end})')" for w in words)
    return f"list_filter(list_transform(flatten([{found}]), lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g')), lambda q: length(q) > 10 AND length(q) < 200)"


query(
    "FUN17_mined_questions",
    rf"""WITH d AS ({TITLES}), q AS (SELECT *, {phrase_sql(T.ASKING_RU, '[.!?]')} AS ru, {phrase_sql(T.ASKING_EN, '[?]')} AS en,
        list_concat(CASE WHEN title <> '' THEN ['Что такое ' || title || '?'] ELSE [] END, CASE WHEN section <> '' AND section <> title THEN ['Как работает ' || section || '?'] ELSE [] END) AS a FROM d WHERE text IS NOT NULL),
    m AS (SELECT *, list_concat(a, CASE WHEN kind = 'jira' THEN ['Как решить эту задачу?'] WHEN kind = 'confluence' THEN ['О чём этот документ?'] WHEN kind <> '' AND len(a) < 2 THEN ['Что содержится в этом документе?'] ELSE [] END) AS told FROM q)
    SELECT doc_id, array_to_string((CASE WHEN len(ru) > 0 THEN ru WHEN len(en) > 0 THEN en WHEN len(told) > 0 THEN told ELSE ['Что такое ' || left(trim(split_part(regexp_replace(text, '([.!?])\s+', '\1' || chr(1)), chr(1), 1)), 100) || '?'] END)[1:3], chr(10)) AS questions FROM m""",
)(
    lambda t: t.documents.where("text is not null").select(
        "doc_id", F.expr(PLANTED).alias("text"), F.expr("CASE WHEN doc_id % 5 <> 3 THEN 'doc ' || doc_id ELSE '' END").alias("title"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'part ' || doc_id % 3 ELSE '' END").alias("section"),
        F.expr("CASE doc_id % 4 WHEN 0 THEN 'jira' WHEN 1 THEN 'confluence' WHEN 2 THEN 'git' ELSE '' END").alias("kind"),
    ).select("doc_id", F.array_join(T.mined_questions(c("text"), c("title"), c("section"), c("kind")), "\n").alias("questions"))
)
query(
    "FUN06_nine_fields",
    """SELECT doc_id, sha256('{"doc_title": ' || to_json('doc ' || doc_id)::VARCHAR || ', "entities": ["' || lang || '", "x"], "keywords": [' || CASE WHEN 'a' < source THEN '"a", ' || to_json(source)::VARCHAR ELSE to_json(source)::VARCHAR || ', "a"' END || '], "source_id": ' || to_json(doc_id::VARCHAR)::VARCHAR
        || ', "source_type": ' || to_json(source)::VARCHAR || ', "summary": "", "text": ' || to_json(text)::VARCHAR || ', "title": ' || to_json(left(text, 20))::VARCHAR || ', "version": "1"}') AS hash FROM documents WHERE text IS NOT NULL AND lang < 'x'""",
)(
    lambda t: t.documents.where("text is not null and lang < 'x'").select(
        "doc_id",
        T.chunk_hash(
            {"text": c("text"), "title": F.substring("text", 1, 20), "source_type": c("source"), "source_id": c("doc_id").cast("string"), "version": F.lit("1"), "doc_title": F.concat(F.lit("doc "), c("doc_id")), "summary": F.lit(None).cast("string")},
            {"keywords": F.array(c("source"), F.lit("a")), "entities": F.array(F.lit("x"), c("lang"))},
        ).alias("hash"),
    )
)
