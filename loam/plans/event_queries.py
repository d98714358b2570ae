"""Queries of usage, feedback, A/B and quality aggregates (AGG, WIN13, FLT10-12, STR rows).

events is the usage log: event_type stands for model, variant or rating, value
for latency or tokens. A day is that of the event.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import sketches as S
from ..operators.evaluation import action
from .registry import query

c = F.col

query("AGG01_daily_usage", "SELECT ts::DATE AS day, count(*) AS queries, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY 1")(lambda t: A.daily_usage(t.events))
PCT = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(value) FILTER (r = least(floor(n * 0.5::DOUBLE)::BIGINT, n - 1)) AS p50, coalesce(max(value) FILTER (r = least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1) AND n > 1), 0) AS p95,
    coalesce(max(value) FILTER (r = least(floor(n * 0.99::DOUBLE)::BIGINT, n - 1) AND n > 2), 0) AS p99 FROM r GROUP BY 1"""
query("AGG02_percentiles", PCT)(lambda t: A.percentile(t.events, ["event_type"], "value", {"p50": (0.5, 0), "p95": (0.95, 1), "p99": (0.99, 2)}))
query(
    "AGG03_overview",
    "SELECT count(*) AS total, round(count(*) / 720.0::DOUBLE, 6) AS per_hour, count(DISTINCT user_id) AS users, round(count(*) / count(DISTINCT user_id)::DOUBLE, 6) AS per_user FROM events WHERE ts < TIMESTAMP '2024-01-31'",
)(lambda t: t.events.where(c("ts") < F.lit("2024-01-31").cast("timestamp_ntz")).agg(F.count("*").alias("total"), F.round(F.count("*") / 720, 6).alias("per_hour"), F.countDistinct("user_id").alias("users"), F.round(F.count("*") / F.countDistinct("user_id"), 6).alias("per_user")))
query("AGG03_top_users", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")(lambda t: t.events.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10))
HALVES = "WITH h AS (SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS cur, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS prev FROM events GROUP BY 1)"
query("AGG04_trend", f"{HALVES} SELECT event_type, CASE WHEN prev = 0 THEN CASE WHEN cur > 0 THEN '+∞%' ELSE '0%' END ELSE CASE WHEN round((cur - prev) * 100 / prev::DOUBLE) >= 0 THEN '+' ELSE '' END || round((cur - prev) * 100 / prev::DOUBLE)::BIGINT || '%' END AS trend FROM h")(
    lambda t: t.events.groupBy("event_type").agg(F.count_if(c("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")).alias("cur"), F.count_if(c("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("prev")).select("event_type", A.trend(c("cur"), c("prev")).alias("trend"))
)
query(
    "AGG05_daily_breakdown",
    """WITH d AS (SELECT unnest(range(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY))::DATE AS day), k AS (SELECT DISTINCT event_type FROM events), n AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, day, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM events)::DOUBLE, 6) AS share FROM k CROSS JOIN d LEFT JOIN n USING (event_type, day)""",
)(
    lambda t: t.events.select("event_type").distinct().withColumn("day", F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-04").cast("date")))).join(
        t.events.groupBy("event_type", A.day_of(c("ts")).alias("day")).agg(F.count("*").alias("n")), ["event_type", "day"], "left"
    ).crossJoin(F.broadcast(t.events.agg(F.count("*").alias("all")))).select("event_type", "day", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / c("all"), 6).alias("share"))
)
query("WIN13_period_over_period", """WITH w AS (SELECT (epoch_us(ts) // 604800000000) AS week, count(*) AS n FROM events GROUP BY 1) SELECT week, n, lag(n) OVER (ORDER BY week) AS previous FROM w""")(
    lambda t: t.events.groupBy(F.floor(F.unix_micros(c("ts").cast("timestamp")) / 604800000000).alias("week")).agg(F.count("*").alias("n")).withColumn("previous", F.lag("n").over(Window.orderBy("week")))
)

# ---- feedback: event_type as rating, props.k as score


def feedback(t):
    return t.events.select("event_id", "ts", "user_id", "event_type", (c("value") / 100).alias("confidence"), F.get_json_object("props", "$.k").cast("int").alias("k"))


FB = "WITH f AS (SELECT event_id, ts, user_id, event_type, value / 100 AS confidence, (props->>'k')::INT AS k FROM events)"
query("AGG06_feedback_stats", f"{FB} SELECT event_type, count(*) AS total, count(*) FILTER (k > 5) AS positive, round(count(*) FILTER (k > 5) / count(*)::DOUBLE, 6) AS ratio, round(avg(confidence), 6) AS confidence FROM f GROUP BY 1")(
    lambda t: feedback(t).groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(c("k") > 5).alias("positive"), F.round(F.count_if(c("k") > 5) / F.count("*"), 6).alias("ratio"), F.round(F.avg("confidence"), 6).alias("confidence"))
)
query("AGG06_feedback_volume", f"{FB} SELECT user_id, event_type, count(*) AS n FROM f WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY GROUPING SETS ((user_id, event_type), (event_type), ())")(
    lambda t: t.spark.sql("SELECT user_id, event_type, count(*) AS n FROM {f} WHERE ts >= timestamp_ntz '2024-01-05' AND ts < timestamp_ntz '2024-01-25' GROUP BY GROUPING SETS ((user_id, event_type), (event_type), ())", f=feedback(t))
)
RATED = "SELECT user_id, 'c' || (i % 50) AS chunk_id, (i % 5 + 1)::INT AS score FROM (SELECT user_id, event_id + j AS i FROM events, range(3) AS r(j))"
ratings = lambda t: t.events.select("user_id", "event_id", F.explode(F.from_json(F.to_json(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.struct(F.concat(F.lit("c"), (c("event_id") + j) % 50).alias("chunk_id"), ((c("event_id") + j) % 5 + 1).cast("int").alias("relevance_score")))), "array<struct<chunk_id:string,relevance_score:int>>")).alias("r")).select("user_id", "event_id", "r.chunk_id", c("r.relevance_score").alias("score"))
query("AGG07_chunk_ratings", f"SELECT chunk_id, round(avg(score), 6) AS average, count(*) AS n, count(*) FILTER (score <= 2) AS low FROM ({RATED}) GROUP BY 1 HAVING count(*) >= 2")(
    lambda t: ratings(t).groupBy("chunk_id").agg(F.round(F.avg("score"), 6).alias("average"), F.count("*").alias("n"), F.count_if(c("score") <= 2).alias("low")).where("n >= 2")
)
query("EVA29_negative_pairs", f"SELECT DISTINCT user_id, chunk_id FROM ({RATED}) WHERE score <= 2")(lambda t: ratings(t).where("score <= 2").select("user_id", "chunk_id").distinct())
query("EVA30_preference_pairs", f"{FB} SELECT event_id, CASE WHEN k = 3 THEN 'corrected' ELSE event_type END AS answer FROM f WHERE k > 5 OR k = 3")(lambda t: feedback(t).where("k > 5 or k = 3").select("event_id", F.coalesce(F.when(c("k") == 3, "corrected"), c("event_type")).alias("answer")))
query("FLT10_feedback_listing", f"{FB} SELECT event_id, k, count(*) OVER () AS total FROM f WHERE k >= 5 AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")(
    lambda t: (lambda d: d.crossJoin(F.broadcast(d.agg(F.count("*").alias("total")))).orderBy(F.desc("ts"), "event_id").offset(20).limit(20).select("event_id", "k", "total"))(feedback(t).where((c("k") >= 5) & (c("event_type") == "click")))
)
query("FLT11_task_listing", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 10 = 1")(lambda t: t.orders.where((c("o_orderstatus") != "F") & (c("o_custkey") % 10 == 1)).select("o_orderkey", "o_orderstatus"))
query("FLT12_audit_history", "SELECT event_id, ts FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 50")(
    lambda t: t.events.where((c("user_id") == 7) & (c("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts")
)
query("SRC21_latest_rows", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")(lambda t: t.events.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts"))
query("AGG10_audit_report", "SELECT event_type, count(*) AS n, round(sum(coalesce(value, 0)), 4) AS tokens FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1")(
    lambda t: t.events.where(c("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("tokens"))
)
query("AGG11_queue_status", "SELECT count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'F') AS dead, count(*) AS total FROM orders")(lambda t: t.orders.agg(F.count_if(c("o_orderstatus") == "O").alias("pending"), F.count_if(c("o_orderstatus") == "F").alias("dead"), F.count("*").alias("total")))
query("AGG12_kb_stats", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS doc_count FROM orders GROUP BY 1")(lambda t: t.orders.groupBy("o_custkey").agg(F.count_if(c("o_orderstatus") == "F").alias("doc_count")))
stats = lambda by: f"SELECT {', '.join(by)}, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, min(value) AS min, max(value) AS max, round(sum(value), 4) AS sum FROM events GROUP BY {', '.join(by)}"
query("AGG15_metric_stats", stats(["event_type"]))(lambda t: A.metric_stats(t.events, ["event_type"], "value"))
query("AGG30_ab_report", stats(["event_type", "user_id"]))(lambda t: A.metric_stats(t.events, ["event_type", "user_id"], "value"))
AB = "WITH s AS (SELECT avg(value) FILTER (event_type = 'click') AS m1, var_samp(value) FILTER (event_type = 'click') AS v1, count(*) FILTER (event_type = 'click') AS n1, avg(value) FILTER (event_type = 'view') AS m2, var_samp(value) FILTER (event_type = 'view') AS v2, count(*) FILTER (event_type = 'view') AS n2 FROM events)"
query("AGG16_welch")(lambda t: A.welch(t.events, "event_type", "value", "click", "view"))
query("AGG17_effect_size", f"{AB} SELECT round(coalesce((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 0), 6) AS d, n1, n2 FROM s")(lambda t: A.effect_size(t.events, "event_type", "value", "click", "view"))
query("AGG18_comparison", "SELECT a.event_type AS a, b.event_type AS b, round(a.m - b.m, 6) AS difference, a.n AS n_a, b.n AS n_b FROM (SELECT event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY 1) a JOIN (SELECT event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY 1) b ON a.event_type < b.event_type")(
    lambda t: (lambda s: s.select(c("event_type").alias("a"), c("m").alias("ma"), c("n").alias("n_a")).join(F.broadcast(s.select(c("event_type").alias("b"), c("m").alias("mb"), c("n").alias("n_b"))), c("a") < c("b")).select("a", "b", F.round(c("ma") - c("mb"), 6).alias("difference"), "n_a", "n_b"))(
        t.events.groupBy("event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    )
)
query("AGG19_canary_errors", "SELECT user_id % 5 AS model, round(coalesce(count(*) FILTER (event_type = 'error' AND event_id % 2 = 0) / nullif(count(*) FILTER (event_id % 2 = 0), 0)::DOUBLE, 0), 6) AS stable, round(coalesce(count(*) FILTER (event_type = 'error' AND event_id % 2 = 1) / nullif(count(*) FILTER (event_id % 2 = 1), 0)::DOUBLE, 0), 6) AS canary FROM events GROUP BY 1")(
    lambda t: t.events.groupBy((c("user_id") % 5).alias("model")).agg(*[F.round(F.coalesce(F.try_divide(F.count_if((c("event_type") == "error") & (c("event_id") % 2 == r)), F.count_if(c("event_id") % 2 == r)), F.lit(0.0)), 6).alias(n) for r, n in ((0, "stable"), (1, "canary"))])
)
query("EVA26_canary_rollback", "SELECT user_id % 50 AS model, count(*) AS n, count(*) >= 100 AND count(*) FILTER (event_type = 'error') / count(*)::DOUBLE > 0.05 AS rollback FROM events GROUP BY 1")(
    lambda t: t.events.groupBy((c("user_id") % 50).alias("model")).agg(F.count("*").alias("n"), ((F.count("*") >= 100) & (F.count_if(c("event_type") == "error") / F.count("*") > 0.05)).alias("rollback"))
)
query("FUN62_canary_state", "WITH e AS (SELECT user_id % 50 AS model, max(ts) AS last, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1) SELECT model, CASE WHEN errors > 30 THEN 'rolled_back' WHEN last < TIMESTAMP '2024-01-30' THEN 'cooldown' ELSE 'running' END AS state FROM e")(
    lambda t: t.events.groupBy((c("user_id") % 50).alias("model")).agg(F.max("ts").alias("last"), F.count_if(c("event_type") == "error").alias("errors")).select("model", F.when(c("errors") > 30, "rolled_back").when(c("last") < F.lit("2024-01-30").cast("timestamp_ntz"), "cooldown").otherwise("running").alias("state"))
)
query("AGG33_traffic_split", "SELECT event_id, CASE WHEN ('0x' || substr(sha256(user_id::VARCHAR), 1, 8))::BIGINT % 10000 / 10000.0 < 0.8 THEN 'control' ELSE 'treatment' END AS variant FROM events")(lambda t: t.events.select("event_id", A.routed(c("user_id"), {"control": 0.8, "treatment": 0.2}).alias("variant")))
query("EVA25_eval_gate", "WITH m AS (SELECT event_type AS metric, avg(value) / 100 AS v FROM events GROUP BY 1), g AS (SELECT metric, v, CASE WHEN v >= 0.6::DOUBLE THEN 0 WHEN v >= 0.58::DOUBLE THEN 1 ELSE 2 END AS severity FROM m) SELECT metric, round(v, 6) AS value, (['PASS', 'WARN', 'FAIL'])[severity + 1] AS status, (SELECT (['PASS', 'WARN', 'FAIL'])[max(severity) + 1] FROM g) AS overall FROM g")(
    lambda t: (lambda g: g.crossJoin(F.broadcast(g.agg(F.max("severity").alias("worst")))).select("metric", F.round("v", 6).alias("value"), F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), c("severity") + 1).alias("status"), F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), c("worst") + 1).alias("overall")))(
        t.events.groupBy(c("event_type").alias("metric")).agg((F.avg("value") / 100).alias("v")).withColumn("severity", F.when(c("v") >= 0.6, 0).when(c("v") >= 0.58, 1).otherwise(2))
    )
)
query("EVA35_gate_with_actions", "SELECT event_type AS metric, CASE WHEN avg(value) / 100 >= 0.6::DOUBLE THEN 'USE' WHEN avg(value) / 100 >= 0.4::DOUBLE THEN 'REWRITE' WHEN avg(value) / 100 >= 0.2::DOUBLE THEN 'EXPAND' ELSE 'FALLBACK' END AS action FROM events GROUP BY 1")(
    lambda t: t.events.groupBy(c("event_type").alias("metric")).agg((F.avg("value") / 100).alias("v")).select("metric", action(c("v"), 0.6, 0.4, 0.2).alias("action"))
)

# ---- corpus quality

PIECES = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"
query("AGG08_data_quality", f"WITH d AS (SELECT source, n_chars, len({PIECES}) AS w FROM documents) SELECT source, round(avg(CASE WHEN w BETWEEN 50 AND 800 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END), 6) AS coherence, count(*) FILTER (n_chars > 5000) AS stale, round(0.3::DOUBLE * 80 + 0.4::DOUBLE * avg(CASE WHEN w BETWEEN 50 AND 800 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END) * 100 + 0.3::DOUBLE * (1 - count(*) FILTER (n_chars > 5000) / count(*)::DOUBLE) * 100, 4) AS overall FROM d GROUP BY ROLLUP (source)")(
    lambda t: t.documents.select("source", "n_chars", F.when(F.size(T.pieces(c("text"))).between(50, 800), 0.7).otherwise(0.5).alias("co")).rollup("source").agg(
        F.round(F.avg("co"), 6).alias("coherence"), F.count_if(c("n_chars") > 5000).alias("stale"), F.round(F.lit(0.3) * 80 + F.lit(0.4) * F.avg("co") * 100 + F.lit(0.3) * (1 - F.count_if(c("n_chars") > 5000) / F.count("*")) * 100, 4).alias("overall")
    )
)
query("AGG09_etl_report", f"WITH d AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1), k AS (SELECT source, count(*) AS chunks, round(avg(w), 6) AS mean_words, min(w)::BIGINT AS min_words, max(w)::BIGINT AS max_words FROM (SELECT source, len({PIECES}) AS w FROM (SELECT source, unnest(string_split(text, chr(10))) AS text FROM documents)) GROUP BY 1) SELECT * FROM d FULL JOIN k USING (source)")(
    lambda t: t.documents.groupBy("source").agg(F.count("*").alias("docs")).join(
        t.documents.select("source", F.explode(F.split("text", "\n")).alias("x")).select("source", F.size(T.pieces(c("x"))).cast("long").alias("w")).groupBy("source").agg(F.count("*").alias("chunks"), F.round(F.avg("w"), 6).alias("mean_words"), F.min("w").alias("min_words"), F.max("w").alias("max_words")), "source", "full"
    )
)
query("AGG13_coverage", "SELECT source, count(*) AS chunks, count(DISTINCT lang) AS languages, count(DISTINCT lang) = 1 AS single_source, max(doc_id) < 990 AS outdated FROM documents GROUP BY 1")(
    lambda t: t.documents.groupBy("source").agg(F.count("*").alias("chunks"), F.countDistinct("lang").alias("languages"), (F.countDistinct("lang") == 1).alias("single_source"), (F.max("doc_id") < 990).alias("outdated"))
)
query("AGG14_integrity_score", "WITH g AS (SELECT lang, count(DISTINCT source) AS s, count(*) FILTER (n_chars < 100) AS bad FROM documents GROUP BY 1) SELECT lang, greatest(0, least(100, 100 - least(2 * bad, 40) - (50 - least(10 * s, 50)) + CASE WHEN lang = 'en' THEN 10 ELSE 0 END))::BIGINT AS score FROM g")(
    lambda t: t.documents.groupBy("lang").agg(F.countDistinct("source").alias("s"), F.count_if(c("n_chars") < 100).alias("bad")).select("lang", F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.least(2 * c("bad"), F.lit(40)) - (50 - F.least(10 * c("s"), F.lit(50))) + F.when(c("lang") == "en", 10).otherwise(0))).cast("long").alias("score"))
)
query("AGG22_table_quality", "SELECT l_returnflag, round(avg(cols), 6) AS cols, count(*) AS rows, round(count(*) FILTER (cols = 4) / count(*)::DOUBLE, 6) AS consistency FROM (SELECT l_returnflag, len(string_split(concat_ws('|', l_orderkey, l_partkey, l_suppkey, CASE WHEN l_discount > 0.05::DOUBLE THEN 'x' END), '|')) AS cols FROM lineitem) GROUP BY 1")(
    lambda t: t.lineitem.select("l_returnflag", F.size(F.split(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", F.when(c("l_discount") > 0.05, "x")), r"\|")).alias("cols")).groupBy("l_returnflag").agg(F.round(F.avg("cols"), 6).alias("cols"), F.count("*").alias("rows"), F.round(F.count_if(c("cols") == 4) / F.count("*"), 6).alias("consistency"))
)
query("AGG23_ocr_quality", "SELECT user_id, count(*) AS pages, count(*) FILTER (value > 20) AS with_text, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY 1")(
    lambda t: t.events.groupBy("user_id").agg(F.count("*").alias("pages"), F.count_if(c("value") > 20).alias("with_text"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
)
query("AGG24_overall_score", "SELECT user_id, round(coalesce(list_avg([x FOR x IN [a, b] IF x IS NOT NULL]), 100), 6) AS score FROM (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'error') AS b FROM events GROUP BY 1)")(
    lambda t: t.events.groupBy("user_id").agg(F.avg(F.when(c("event_type") == "click", c("value"))).alias("a"), F.avg(F.when(c("event_type") == "error", c("value"))).alias("b")).select("user_id", F.round(F.coalesce(F.try_divide(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), c("a").isNotNull().cast("int") + c("b").isNotNull().cast("int")), F.lit(100.0)), 6).alias("score"))
)

# ---- conversations

query("AGG29_turn_tokens", "SELECT conv_id, sum(length(text) // 4)::BIGINT AS tokens, sum(length(text) // 4) > 200 AS summarise FROM conversations GROUP BY 1")(lambda t: t.conversations.groupBy("conv_id").agg(F.sum(T.quarter_tokens(c("text"))).alias("tokens"), (F.sum(T.quarter_tokens(c("text"))) > 200).alias("summarise")))
RANKED = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations"
recent = lambda t: t.conversations.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
query("WIN12_recent_turns", f"SELECT conv_id, turn, r <= 5 AS recent FROM ({RANKED})")(lambda t: recent(t).select("conv_id", "turn", (c("r") <= 5).alias("recent")))
query("WIN15_conversation_context", f"SELECT conv_id, left(string_agg(role || ': ' || text, chr(10) ORDER BY turn), 400) AS context FROM ({RANKED}) WHERE r <= 4 GROUP BY 1")(
    lambda t: recent(t).where("r <= 4").groupBy("conv_id").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("x")))), lambda s: s["x"]), "\n"), 1, 400).alias("context"))
)
QA = "WITH t AS (SELECT *, lag(role) OVER w AS before, lag(text) OVER w AS question FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), q AS (SELECT conv_id, turn, question, text AS answer FROM t WHERE role = 'assistant' AND before = 'user')"


def pairs(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    d = t.conversations.where(c("role").isin("user", "assistant")).withColumn("before", F.lag("role").over(w)).withColumn("question", F.lag("text").over(w))
    return d.where((c("role") == "assistant") & (c("before") == "user")).select("conv_id", "turn", "question", c("text").alias("answer"))


query("WIN10_question_answer", f"{QA} SELECT * FROM q")(pairs)
query("JOI10_qa_chunks", f"{QA} SELECT conv_id, turn, sha256(question || chr(10) || answer) AS id FROM q")(lambda t: pairs(t).select("conv_id", "turn", F.sha2(F.concat_ws("\n", "question", "answer"), 256).alias("id")))
query("CHK12_qa_documents", f"{QA} SELECT conv_id, 'Q: ' || question || chr(10) || 'A: ' || answer AS content FROM q UNION ALL SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FROM conversations ANTI JOIN q USING (conv_id) GROUP BY 1")(
    lambda t: pairs(t).select("conv_id", F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("content")).unionByName(
        t.conversations.join(pairs(t).select("conv_id").distinct(), "conv_id", "left_anti").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("content"))
    )
)
query("FUN56_enriched_query", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS query FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2 GROUP BY 1")(lambda t: recent(t).where("r <= 2").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ").alias("query")))
query("AGG28_mention_sketch")(lambda t: S.frequent(t.conversations.select(F.explode(S.mentions(c("text"))).alias("item")), 500))
query("AGG28_top_mentions", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM conversations) GROUP BY 1 ORDER BY n DESC, word LIMIT 20")(
    lambda t: t.conversations.select(F.explode(T.words(c("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)
)

# ---- batch forms of the streaming rows

query("STR05_event_routing", "SELECT event_id, CASE WHEN (props->>'k') IS NULL THEN 'rejected' WHEN event_type IN ('click', 'view') THEN 'index' ELSE 'log' END AS route FROM events")(
    lambda t: t.events.select("event_id", F.when(F.get_json_object("props", "$.k").isNull(), "rejected").when(c("event_type").isin("click", "view"), "index").otherwise("log").alias("route"))
)
query("STR08_retries", "SELECT event_id, r AS retries, CASE WHEN r >= 3 THEN 'dead' ELSE 'pending' END AS status, ts + to_seconds(pow(2, r)::BIGINT) AS next_try FROM (SELECT event_id, ts, (event_id % 5)::INT AS r FROM events WHERE event_type = 'error')")(
    lambda t: t.events.where("event_type = 'error'").select("event_id", "ts", (c("event_id") % 5).cast("int").alias("retries")).select("event_id", "retries", F.when(c("retries") >= 3, "dead").otherwise("pending").alias("status"), F.expr("ts + make_dt_interval(0, 0, 0, pow(2, retries))").alias("next_try"))
)
query(
    "STR10_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, s""",
)(lambda t: t.events.withColumn("ts", c("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n")).select("user_id", c("s.start").cast("timestamp_ntz").alias("start"), c("s.end").cast("timestamp_ntz").alias("stop"), "n"))
query("STR11_ttl_expiry", "SELECT event_id, ts + INTERVAL 1 HOUR < TIMESTAMP '2024-01-15' AS expired FROM events")(lambda t: t.events.select("event_id", (F.expr("ts + interval 1 hour") < F.lit("2024-01-15").cast("timestamp_ntz")).alias("expired")))
query("STR12_task_lifecycle", "SELECT user_id, event_type AS status, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")(
    lambda t: t.events.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("r = 1").select("user_id", c("event_type").alias("status"), "ts")
)
query("AGG18_variant_comparison")(lambda t: A.compared(t.events.select("event_type", "value"), "event_type", "value", "click", "view"))
query(
    "AGG30_trial_report",
    """WITH v AS (SELECT event_type AS variant, 'value' AS metric, value AS x FROM events UNION ALL SELECT event_type, 'hour', hour(ts)::DOUBLE FROM events),
    m AS (SELECT variant, metric, count(x) AS n, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, min(x) AS min, max(x) AS max FROM v WHERE x IS NOT NULL GROUP BY ALL),
    t AS (SELECT event_type, count(*) AS trials FROM events GROUP BY 1)
    SELECT variant, trials, (SELECT count(*) FROM events) AS total_trials, CASE variant WHEN 'view' THEN 0.7::DOUBLE WHEN 'click' THEN 0.3::DOUBLE ELSE 1 END::DOUBLE AS weight, metric, n, mean, std, min, max FROM m JOIN t ON event_type = variant""",
)(lambda t: A.trial_report(t.events.select("event_type", "value", F.hour("ts").alias("hour")), "event_type", ["value", "hour"], {"view": 0.7, "click": 0.3}))
query(
    "FUN56_query_with_names",
    r"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations), q AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS recent FROM r WHERE r <= 2 GROUP BY 1),
    w AS (SELECT conv_id, regexp_replace(regexp_replace(unnest(regexp_split_to_array(text, '\s+')), '^[.,;:!?()\[\]{}''"]+', ''), '[.,;:!?()\[\]{}''"]+$', '') AS name FROM conversations),
    n AS (SELECT conv_id, name, count(*) AS n FROM w WHERE length(name) > 2 AND regexp_matches(name, '^\p{Lu}|[_-]') GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, name) AS place FROM n),
    e AS (SELECT conv_id, string_agg(name, ', ' ORDER BY place) AS names FROM o WHERE place <= 5 GROUP BY 1)
    SELECT conv_id, recent || coalesce(' Entities mentioned in conversation: ' || names, '') AS query FROM q LEFT JOIN e USING (conv_id)""".replace("\\\\", "\\"),
)(
    lambda t: recent(t).where("r <= 2").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), " ").alias("recent")).join(top_names(t), "conv_id", "left").select(
        "conv_id", F.concat(c("recent"), F.coalesce(F.concat(F.lit(" Entities mentioned in conversation: "), c("names")), F.lit(""))).alias("query")
    )
)


def top_names(t):
    """conv_id and names: the five names that a conversation mentions most, ties by name."""
    counted = t.conversations.select("conv_id", F.explode(S.mentions(c("text"))).alias("name")).groupBy("conv_id", "name").agg(F.count("*").alias("n"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n"), "name"))).where("place <= 5")
    return placed.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda s: s["name"]), ", ").alias("names"))


LAST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1)"
query(
    "STR12_open_tasks",
    f"WITH {LAST} SELECT event_type AS status, count(*) AS tasks, string_agg(user_id::VARCHAR, ',' ORDER BY ts, user_id) AS ids FROM l WHERE event_type IN ('signup', 'view') GROUP BY 1",
)(lambda t: A.open_tasks(t.events.select(c("user_id").alias("task"), c("event_type").alias("status"), "ts", "event_id"), ["signup", "view"], "event_id"))
