"""Queries of search, fusion, ranking and evaluation (RET, TOP, WIN01, EVA, FLT rows).

embeddings serve as queries (every twentieth vector) and corpus; a vector of
the same label is relevant. benchmark items are lexical queries on documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import evaluation as E
from ..operators import pruned as P
from ..operators import ranking as R
from ..operators import vectors as V
from ..operators.similarity import first_matches
from .registry import ORACLE_SQL, Tables, query

c = F.col


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(c("vec_id").alias("id"), "embedding", "label")


def dense(t: Tables, k: int = 50) -> DataFrame:
    v = vectors(t)
    return V.dense_search(v.where(c("id") % 20 == 0).select("id", "embedding"), v.select("id", "embedding"), k)


def sparse(t: Tables, k: int = 20) -> DataFrame:
    return P.lexical_top(t.benchmark.select(c("item_id").alias("id"), "text"), t.documents.select(c("doc_id").alias("id"), "text"), k)


DENSE = """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= {k})"""
SPARSE = r"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM benchmark),
    p AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents) GROUP BY ALL),
    f AS (SELECT word, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM p GROUP BY word),
    s AS (SELECT query_id, doc_id, round(sum((1 + ln(tf)) * idf), 6) AS score FROM q JOIN p USING (word) JOIN f USING (word) GROUP BY ALL),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 20)"""
D50 = DENSE.format(k=50)

query("RET01_dense_search", f"{D50} SELECT query_id, doc_id, score, rank FROM h")(dense)
query("RET02_lexical_search", f"{SPARSE} SELECT query_id, doc_id, score, rank FROM h")(sparse)
query("WIN01_ranks", f"{D50} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM h")(lambda t: R.ranked(dense(t)).select("query_id", "doc_id", "rank"))


def lists(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two lists of each query: its 30 best, and its 30 best of even number by a skewed score."""
    hits = dense(t)
    other = hits.where(c("doc_id") % 2 == 0).withColumn("score", F.round(c("score") * 0.5 + (c("doc_id") % 7) / 20, 9)).drop("rank")
    return hits.where("rank <= 30"), V.top_k(other, 20)


LISTS = f"""{D50}, a AS (SELECT * FROM h WHERE rank <= 30),
    b AS (SELECT * FROM (SELECT query_id, doc_id, s2 AS score, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, doc_id)::INT AS rank
        FROM (SELECT query_id, doc_id, round(score * 0.5::DOUBLE + (doc_id % 7) / 20.0::DOUBLE, 9) AS s2 FROM h WHERE doc_id % 2 = 0)) WHERE rank <= 20),
    n AS (SELECT query_id, count(*) AS n_a FROM a GROUP BY 1), m AS (SELECT query_id, count(*) AS n_b FROM b GROUP BY 1),
    j AS (SELECT query_id, doc_id, a.score AS sa, a.rank AS ra, b.score AS sb, b.rank AS rb FROM a FULL JOIN b USING (query_id, doc_id)),
    f AS (SELECT query_id, doc_id, coalesce(sb, sa) AS score, coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0)
        + CASE WHEN ra IS NOT NULL THEN 1.0::DOUBLE / (120 + greatest(coalesce(n_b, 0), 1)) ELSE 0 END + CASE WHEN rb IS NOT NULL THEN 1.0::DOUBLE / (120 + greatest(coalesce(n_a, 0), 1)) ELSE 0 END AS rrf,
        coalesce(1.0::DOUBLE / (60 + ra), 0) + coalesce(1.0::DOUBLE / (60 + rb), 0) AS plain FROM j LEFT JOIN n USING (query_id) LEFT JOIN m USING (query_id))"""
fused = lambda t, **k: R.fuse(*lists(t), **k).withColumn("rrf_score", F.round("rrf_score", 9))
query("RET03_rrf", f"{LISTS} SELECT query_id, doc_id, score, round(rrf, 9) AS rrf_score FROM f")(lambda t: fused(t))
query("JOI01_fused_merge", f"{LISTS} SELECT query_id, doc_id, score, round(plain, 9) AS rrf_score FROM f")(lambda t: fused(t, sentinel=False))
query(
    "SET06_multi_query_fusion",
    f"""{LISTS}, g AS (SELECT query_id // 40 AS query_id, doc_id, max(rrf) AS score FROM f GROUP BY ALL)
    SELECT query_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INT AS rank FROM g QUALIFY rank <= 10""",
)(lambda t: V.top_k(R.fuse(*lists(t)).groupBy(F.floor(c("query_id") / 40).alias("query_id"), "doc_id").agg(F.round(F.max("rrf_score"), 9).alias("score")), 10))
query(
    "RET04_cosine",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)(
    lambda t: vectors(t).select(c("id").alias("a"), c("embedding").alias("ea")).join(vectors(t).select((c("id") - 1).alias("a"), c("id").alias("b"), c("embedding").alias("eb")), "a").select("a", "b", F.round(V.cosine(c("ea"), c("eb")), 6).alias("cosine"))
)
part = lambda e, i: F.slice(e, 1 + 16 * i, 16)
COSQ = "list_cosine_similarity(q.embedding[{a}:{b}]::DOUBLE[], d.embedding[{e}:{f}]::DOUBLE[])"
MAXSIM = "(" + " + ".join("greatest(0.0::DOUBLE, " + ", ".join(COSQ.format(a=1 + 16 * i, b=16 + 16 * i, e=1 + 16 * j, f=16 + 16 * j) for j in range(4)) + ")" for i in range(4)) + ") / 4"
query("RET05_late_interaction", f"SELECT q.vec_id AS a, d.vec_id AS b, round({MAXSIM}, 6) AS score FROM embeddings q JOIN embeddings d ON d.vec_id = q.vec_id + 1")(
    lambda t: vectors(t).select(c("id").alias("a"), c("embedding").alias("ea")).join(vectors(t).select((c("id") - 1).alias("a"), c("id").alias("b"), c("embedding").alias("eb")), "a").select(
        "a", "b", F.round(V.late_interaction(F.array(*[part(c("ea"), i) for i in range(4)]), F.array(*[part(c("eb"), i) for i in range(4)])), 6).alias("score")
    )
)
query(
    "RET06_semantic_cache",
    """WITH k AS (SELECT vec_id, embedding, floor(embedding[1]::DOUBLE * 10)::INT || ',' || floor(embedding[2]::DOUBLE * 10)::INT AS key FROM embeddings)
    SELECT a.vec_id AS id, min(b.vec_id) AS hit FROM k a JOIN k b ON a.key = b.key AND b.vec_id < a.vec_id AND round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.2::DOUBLE GROUP BY 1""",
)(
    lambda t: P.first_within(vectors(t).withColumn("key", F.concat(*[x for i in range(2) for x in (F.lit("," if i else ""), F.floor(F.get("embedding", F.lit(i)).cast("double") * 10).cast("string"))])), 0.2)
)
def asked_again(t: Tables) -> DataFrame:
    """A log of queries: every vector, one a minute, and each third one again later with one component turned round."""
    v = vectors(t)
    turned = F.transform("embedding", lambda x, i: F.when(i == c("id") % 64, -x).otherwise(x))
    again = v.where(c("id") % 3 == 0).select((c("id") + 1_000_000).alias("id"), (c("id") * 60 + c("id") % 7 * 1000 + 1).alias("ts"), turned.alias("embedding"))
    return v.select("id", (c("id") * 60).alias("ts"), "embedding").unionByName(again)


query(
    "RET07_query_cache",
    """WITH l AS (SELECT vec_id AS id, vec_id * 60 AS ts, embedding AS e FROM embeddings UNION ALL
        SELECT vec_id + 1000000, vec_id * 60 + vec_id % 7 * 1000 + 1, list_transform(embedding, lambda x, i: CASE WHEN i - 1 = vec_id % 64 THEN -x ELSE x END) FROM embeddings WHERE vec_id % 3 = 0),
    s AS (SELECT a.id, a.ts, b.id AS hit, b.ts AS hit_ts, round(list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]), 6) AS score FROM l a JOIN l b ON b.ts < a.ts AND a.ts - b.ts <= 3600)
    SELECT id, ts::DOUBLE AS ts, hit, score FROM (SELECT *, row_number() OVER (PARTITION BY id, ts ORDER BY score DESC, hit_ts, hit) AS r FROM s WHERE score >= 0.95::DOUBLE) WHERE r = 1""",
)(lambda t: P.similar_before(asked_again(t), 0.95, 3600.0))
query(
    "RET08_embedding_cache",
    r"""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS key, list_filter(list_distinct(regexp_split_to_array(lower(text), '\s+')), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    e AS (SELECT key, min(doc_id) AS same FROM d GROUP BY key),
    n AS (SELECT a.doc_id, min(b.doc_id) AS near FROM d a JOIN d b ON b.doc_id < a.doc_id AND 20 * least(len(a.w), len(b.w)) >= 19 * greatest(len(a.w), len(b.w))
        WHERE len(a.w) > 0 AND 20 * len(list_intersect(a.w, b.w)) >= 19 * greatest(len(a.w), len(b.w)) GROUP BY 1)
    SELECT * FROM (SELECT doc_id, CASE WHEN same < doc_id THEN same ELSE near END AS hit, same < doc_id AS exact FROM d JOIN e USING (key) LEFT JOIN n USING (doc_id)) WHERE hit IS NOT NULL""",
)(lambda t: first_matches(t.documents.select(c("doc_id").alias("id"), "text")).select(c("id").alias("doc_id"), "hit", "exact"))


def hypothesis(queries: DataFrame) -> DataFrame:
    """Stands for a model: the mean of a query's vector and its mirror image; none for every hundredth query."""
    mean = F.zip_with("embedding", F.reverse("embedding"), lambda x, y: ((x + y) / 2).cast("float"))
    return queries.select("id", F.when(c("id") % 100 == 0, F.array().cast("array<float>")).otherwise(mean).alias("embedding"))


@query(
    "RET09_hyde_search",
    f"""{LISTS}, hq AS (SELECT vec_id, list_transform(list_zip(embedding, list_reverse(embedding)), lambda z: ((z[1] + z[2]) / 2)::FLOAT) AS e FROM embeddings WHERE vec_id % 20 = 0 AND vec_id % 100 <> 0),
    hs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.e::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score FROM hq q, embeddings d WHERE d.label % 2 = 0 AND q.vec_id <> d.vec_id),
    ff AS (SELECT query_id, doc_id, round(rrf, 9) AS score FROM f WHERE query_id % 100 = 0), u AS (SELECT * FROM hs UNION ALL SELECT * FROM ff)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM u) WHERE rank <= 5""",
)
def hyde(t: Tables) -> DataFrame:
    """Hypothetical vectors against rows of one version; fused search for queries without one."""
    v = vectors(t)
    hybrid = lambda rest: V.top_k(fused(t).join(rest.select(c("id").alias("query_id")), "query_id", "left_semi").select("query_id", "doc_id", c("rrf_score").alias("score")), 5)
    return V.hyde_search(v.where(c("id") % 20 == 0).select("id", "embedding"), v, 5, hypothesis, hybrid, c("label") % 2 == 0)


query(
    "RET10_cross_modal",
    """WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 5) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND d.vec_id % 2 = 1)
    SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 5""",
)(lambda t: V.cosine_search(vectors(t).where(c("id") % 20 == 0), vectors(t).where(c("id") % 2 == 1), 5, digits=5))
tokens = lambda t: vectors(t).select("id", F.array(*[part(c("embedding"), i) for i in range(4)]).alias("vectors"))
MAXSIM_ALL = f"""WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({MAXSIM}, 6) AS max_sim FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY max_sim DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 10"""
query("RET11_multi_vector", MAXSIM_ALL)(lambda t: P.multi_vector_search(tokens(t).where(c("id") % 20 == 0), tokens(t), 10))

# ---- thresholds, knees, orders: scores shifted so that the fixed cutoffs bite

SHIFT = 0.12
shifted = lambda t, k=50: dense(t, k).withColumn("score", F.round(c("score") + SHIFT, 6))
SH = f"{D50}, z AS (SELECT query_id, doc_id, round(score + {SHIFT}::DOUBLE, 6) AS score, rank FROM h)"
LEVELS = f"""{SH}, k AS (SELECT *, CASE WHEN score >= 0.32::DOUBLE THEN 1 WHEN score >= 0.25::DOUBLE THEN 2 END AS class FROM z),
    p AS (SELECT *, count(*) FILTER (class = 1) OVER (PARTITION BY query_id) AS ns, row_number() OVER (PARTITION BY query_id, class ORDER BY score DESC, doc_id) AS place FROM k WHERE class IS NOT NULL),
    l AS (SELECT query_id, doc_id, score, rank, CASE WHEN ns >= 1 THEN 'strong' ELSE 'borderline' END AS level FROM p WHERE class = 1 OR place <= CASE WHEN ns >= 2 THEN 2 WHEN ns = 1 THEN 1 ELSE 3 END)"""
query("FLT02_score_levels", f"{LEVELS} SELECT query_id, doc_id, score, level FROM l")(lambda t: R.threshold(shifted(t)).select("query_id", "doc_id", "score", "level"))
query("FLT15_quality_sufficient", f"{SH} SELECT query_id, count(*) FILTER (score >= 0.32::DOUBLE) >= 2 AS sufficient FROM z GROUP BY 1")(lambda t: shifted(t).groupBy("query_id").agg((F.count_if(c("score") >= 0.32) >= 2).alias("sufficient")))
query("EVA18_generate_or_refuse", f"{SH} SELECT query_id, count(*) FILTER (score >= 0.32::DOUBLE) >= 2 AS generate FROM z WHERE rank <= 10 GROUP BY 1")(lambda t: shifted(t, 10).groupBy("query_id").agg((F.count_if(c("score") >= 0.32) >= 2).alias("generate")))
KNEE = f"""{SH}, r AS (SELECT *, count(*) OVER w AS n, min(score) OVER w AS lo, max(score) OVER w AS hi FROM z WINDOW w AS (PARTITION BY query_id)),
    a AS (SELECT *, CASE WHEN n > 2 AND hi > lo THEN round(abs((rank - 1) / (n - 1)::DOUBLE + (score - lo) / (hi - lo) - 1), 9) END AS away FROM r),
    x AS (SELECT query_id, greatest(2, first(rank ORDER BY away DESC NULLS LAST, rank)) AS knee FROM a GROUP BY 1),
    kn AS (SELECT a.* FROM a JOIN x USING (query_id) WHERE rank <= CASE WHEN n <= 2 THEN n WHEN hi = lo THEN greatest(2, n // 2) ELSE knee END)"""
query("TOP01_knee_pruning", f"{KNEE} SELECT query_id, doc_id, score FROM kn")(lambda t: R.knee(shifted(t)).select("query_id", "doc_id", "score"))
DROP = f"{SH}, g AS (SELECT *, lag(score) OVER (PARTITION BY query_id ORDER BY rank) - score AS fall FROM z), kp AS (SELECT query_id, CASE WHEN count(*) < 3 OR max(fall) <= 0 THEN count(*) ELSE first(rank - 1 ORDER BY fall DESC NULLS LAST, rank) END::BIGINT AS knee FROM g GROUP BY 1)"
query("TOP02_largest_drop", f"{DROP} SELECT query_id, knee FROM kp")(lambda t: R.largest_drop(shifted(t)))
query("TOP03_drop_pruning", f"{DROP} SELECT query_id, doc_id, score FROM z JOIN kp USING (query_id) WHERE rank <= knee")(lambda t: (lambda s: s.join(R.largest_drop(s), "query_id").where("rank <= knee").select("query_id", "doc_id", "score"))(shifted(t)))
query("TOP04_top_k_by_intent", "SELECT event_id, CASE event_type WHEN 'click' THEN 5 WHEN 'view' THEN 15 WHEN 'purchase' THEN 25 WHEN 'error' THEN 0 ELSE 50 END AS k FROM events")(
    lambda t: t.events.select("event_id", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {"click": 5, "view": 15, "purchase": 25, "error": 0}.items() for x in kv]), c("event_type")), F.lit(50)).alias("k"))
)
query("TOP05_top_k_by_complexity", f"{D50}, w AS (SELECT query_id, doc_id, rank, (query_id // 20) % 11 AS cx FROM h) SELECT query_id, doc_id, rank FROM w WHERE rank <= CASE cx {' '.join(f'WHEN {k} THEN {v}' for k, v in T.TOP_K.items())} ELSE 50 END")(
    lambda t: dense(t).where(c("rank") <= T.top_k_of((F.floor(c("query_id") / 20) % 11).cast("int"))).select("query_id", "doc_id", "rank")
)
query("TOP06_rerank", f"{LISTS} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM f QUALIFY rank <= 10")(lambda t: V.top_k(R.fuse(*lists(t)), 10).select("query_id", "doc_id", "rank"))
TWO = f"{D50}, m AS (SELECT * FROM h WHERE rank <= 20), e AS (SELECT query_id, doc_id, round(0.2::DOUBLE * score + 0.8::DOUBLE * ((doc_id % 13) / 13.0::DOUBLE), 6) AS score FROM m)"
query("TOP07_two_stage", f"{TWO} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM e QUALIFY rank <= 5")(
    lambda t: V.top_k(dense(t, 20).select("query_id", "doc_id", F.round(F.lit(0.2) * c("score") + F.lit(0.8) * ((c("doc_id") % 13) / 13), 6).alias("score")), 5)
)
query("TOP08_hybrid_rerank", f"{LISTS}, e AS (SELECT query_id, doc_id, round(0.3::DOUBLE * coalesce(sa, 0) + 0.7::DOUBLE * coalesce(sb, 0), 9) AS score FROM j) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM e QUALIFY rank <= 10")(
    lambda t: (lambda a, b: V.top_k(a.select("query_id", "doc_id", c("score").alias("sa")).join(b.select("query_id", "doc_id", c("score").alias("sb")), ["query_id", "doc_id"], "full").select("query_id", "doc_id", F.round(F.lit(0.3) * F.coalesce("sa", F.lit(0.0)) + F.lit(0.7) * F.coalesce("sb", F.lit(0.0)), 9).alias("score")), 10))(*lists(t))
)
TEN = f"{DENSE.format(k=9)}"
query("TOP09_interleaved", f"{TEN} SELECT query_id, doc_id, CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE 8 - (rank - 1) // 2 END::BIGINT AS place FROM h")(lambda t: dense(t, 9).select("query_id", "doc_id", R.interleaved_order(c("rank"), F.lit(9)).cast("long").alias("place")))
query("TOP10_long_context", f"{TEN} SELECT query_id, doc_id, CASE rank WHEN 1 THEN 0 WHEN 2 THEN 8 ELSE rank - 2 END::BIGINT AS place FROM h")(lambda t: dense(t, 9).select("query_id", "doc_id", R.edges_order(c("rank"), F.lit(9)).cast("long").alias("place")))
query(
    "TOP11_progressive",
    f"""{SH}, s AS (SELECT *, unnest([5, 10, 20]) AS stage FROM z), g AS (SELECT query_id, stage, count(*) FILTER (score >= 0.4::DOUBLE) AS n FROM s WHERE rank <= stage GROUP BY ALL),
    ch AS (SELECT query_id, coalesce(min(stage) FILTER (n >= 2), max(stage)) AS stage FROM g GROUP BY 1) SELECT query_id, doc_id, score, stage FROM s JOIN ch USING (query_id, stage) WHERE rank <= stage""".replace("WITH s AS", "WITH s0 AS").replace("FROM s) WHERE rank <= 50", "FROM s0) WHERE rank <= 50"),
)(lambda t: R.progressive(shifted(t), strong=0.4).select("query_id", "doc_id", "score", "stage"))
query("TOP12_fast_score", f"{DENSE.format(k=5)} SELECT query_id, doc_id, score FROM h")(lambda t: dense(t, 5).select("query_id", "doc_id", "score"))
query("TOP13_rerank_scores", f"{SPARSE} SELECT query_id, doc_id, score FROM h WHERE rank <= 5")(lambda t: sparse(t, 5).select("query_id", "doc_id", "score"))
query("SET03_new_only_union", f"{LISTS} SELECT query_id, doc_id, 'first' AS origin FROM a UNION ALL SELECT query_id, doc_id, 'second' FROM b ANTI JOIN a USING (query_id, doc_id)")(
    lambda t: (lambda a, b: a.select("query_id", "doc_id", F.lit("first").alias("origin")).unionByName(b.join(a, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit("second").alias("origin"))))(*lists(t))
)

# ---- metrics


def metrics(t: Tables) -> DataFrame:
    v = vectors(t)
    return E.class_metrics(dense(t, 20), v.where(c("id") % 20 == 0), v)


idcg = lambda k: f"(SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, {k}) + 1) AS u(i))"
METRICS = f"""{DENSE.format(k=20)}, rel AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
    nn AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
    g AS (SELECT query_id, min(rank) FILTER (hit) AS first, {', '.join(f"count(*) FILTER (hit AND rank <= {k}) AS hits_{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= {k}), 0) AS dcg_{k}" for k in (5, 10, 20))}
        FROM (SELECT h.*, rel.doc_id IS NOT NULL AS hit FROM h LEFT JOIN rel USING (query_id, doc_id)) GROUP BY 1),
    e AS (SELECT query_id, coalesce(1.0::DOUBLE / first, 0) AS rr, {', '.join(f"hits_{k} / n::DOUBLE AS recall_{k}, dcg_{k} / {idcg(k)} AS ndcg_{k}, hits_{k} / {k}.0::DOUBLE AS precision_{k}" for k in (5, 10, 20))} FROM g JOIN nn USING (query_id))"""
query("EVA01_mrr", f"{METRICS} SELECT round(avg(rr), 6) AS mrr FROM e")(lambda t: metrics(t).agg(F.round(F.avg("rr"), 6).alias("mrr")))
for name, col in (("EVA02_recall", "recall"), ("EVA03_ndcg", "ndcg"), ("EVA04_precision", "precision")):
    query(name, f"{METRICS} SELECT query_id, {', '.join(f'round({col}_{k}, 6) AS {col}_{k}' for k in (5, 10, 20))} FROM e")(lambda t, col=col: metrics(t).select("query_id", *[F.round(f"{col}_{k}", 6).alias(f"{col}_{k}") for k in (5, 10, 20)]))
MEANS = "round(avg(rr), 6) AS mrr, " + ", ".join(f"round(avg({m}_{k}), 6) AS {m}_{k}" for k in (5, 10, 20) for m in ("recall", "ndcg", "precision")) + ", count(*) AS num_queries"
query("EVA05_all_metrics", f"{METRICS} SELECT {MEANS} FROM e")(lambda t: E.mean_metrics(metrics(t)))
query("EVA27_by_language_pair", f"{METRICS} SELECT (query_id // 20) % 4 AS pair, {MEANS} FROM e GROUP BY 1")(lambda t: E.mean_metrics(metrics(t).withColumn("pair", F.floor(c("query_id") / 20) % 4), ["pair"]))
query("EVA34_dataset_metrics", f"{METRICS} SELECT k, round(avg(recall), 6) AS recall FROM (SELECT 5 AS k, recall_5 AS recall FROM e UNION ALL SELECT 10, recall_10 FROM e UNION ALL SELECT 20, recall_20 FROM e) GROUP BY k")(
    lambda t: metrics(t).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), c(f"recall_{k}").alias("recall")) for k in (5, 10, 20)])).alias("x")).groupBy("x.k").agg(F.round(F.avg("x.recall"), 6).alias("recall"))
)
query("EVA06_graded_metrics", f"{METRICS} SELECT round(avg(rr), 6) AS mrr, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(precision_5), 6) AS precision_5 FROM e")(lambda t: metrics(t).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"), F.round(F.avg("precision_5"), 6).alias("precision_5")))
CONF = f"""{DENSE.format(k=10)}, z AS (SELECT query_id, score * 2.5::DOUBLE AS s FROM h), v AS (SELECT query_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, avg(s) * 0.4::DOUBLE + (count(*) FILTER (s > 0.7::DOUBLE) + count(*) FILTER (s > 0.4::DOUBLE AND s <= 0.7::DOUBLE) * 0.5::DOUBLE) / count(*) * 0.3::DOUBLE
    + least(1.0::DOUBLE, count(*) / 5.0::DOUBLE) * 0.2::DOUBLE + 1 / (1 + var_pop(s)) * 0.1::DOUBLE)), 6) AS confidence FROM z GROUP BY 1), cf AS (SELECT *, CASE WHEN confidence >= 0.7::DOUBLE THEN 'USE' WHEN confidence >= 0.4::DOUBLE THEN 'REWRITE' WHEN confidence >= 0.2::DOUBLE THEN 'EXPAND' ELSE 'FALLBACK' END AS action FROM v)"""
conf = lambda t: E.retrieval_confidence(dense(t, 10).withColumn("score", c("score") * 2.5))
query("EVA07_confidence", f"{CONF} SELECT query_id, confidence FROM cf")(lambda t: conf(t).select("query_id", "confidence"))
query("RET12_corrective_action", f"{CONF} SELECT query_id, confidence, action FROM cf")(conf)
query("RET13_retrieve_again", f"{CONF} SELECT query_id, confidence < 0.4::DOUBLE AS again FROM cf")(lambda t: conf(t).select("query_id", (c("confidence") < 0.4).alias("again")))
query(
    "EVA08_domain_confidence",
    f"{DENSE.format(k=10)} SELECT query_id, round(least(avg(score) / 0.8::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE + least(count(*) FILTER (score > 0.2::DOUBLE) / count(*)::DOUBLE, 1.0::DOUBLE) * 0.3::DOUBLE + least(count(*) / 5.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE + 0.1::DOUBLE, 6) AS value FROM h GROUP BY 1",
)(lambda t: dense(t, 10).groupBy("query_id").agg(F.round(E.domain_confidence(F.avg("score"), F.count_if(c("score") > 0.2) / F.count("*"), F.count("*"), F.lit(1.0)), 6).alias("value")))
query(
    "EVA19_knowledge_status",
    f"{SH}, g AS (SELECT query_id, count(*) FILTER (score >= 0.32::DOUBLE) AS strong, count(*) AS n, max(score) AS best FROM z WHERE rank <= 10 GROUP BY 1) SELECT q.vec_id AS query_id, coalesce(strong, 0) AS strong, CASE WHEN n IS NULL THEN 'absent' WHEN strong >= 2 THEN 'sufficient' WHEN strong >= 1 THEN 'insufficient' ELSE 'partial' END AS status FROM embeddings q LEFT JOIN g ON g.query_id = q.vec_id WHERE q.vec_id % 10 = 0",
)(
    lambda t: vectors(t).where(c("id") % 10 == 0).select(c("id").alias("query_id")).join(shifted(t, 10).groupBy("query_id").agg(F.count_if(c("score") >= 0.32).alias("strong"), F.count("*").alias("n")), "query_id", "left").select(
        "query_id", F.coalesce("strong", F.lit(0)).alias("strong"), F.when(c("n").isNull(), "absent").when(c("strong") >= 2, "sufficient").when(c("strong") >= 1, "insufficient").otherwise("partial").alias("status")
    )
)
query("EVA31_embedding_grounding", "SELECT a.vec_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS grounding FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")(
    lambda t: vectors(t).select(c("id").alias("vec_id"), c("embedding").alias("ea")).join(vectors(t).select((c("id") - 1).alias("vec_id"), c("embedding").alias("eb")), "vec_id").select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), V.dot(c("ea"), c("eb")))), 6).alias("grounding"))
)
FLAG = "WITH x AS (SELECT doc_id, n_chars AS ctx, (n_chars * (doc_id % 5)) AS ans, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 10) / 10.0::DOUBLE END AS nli, doc_id % 2 AS hits FROM documents), y AS (SELECT *, 0.7::DOUBLE - CASE WHEN ctx < 20 THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN ctx > 0 AND ctx < ans * 0.5::DOUBLE THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN hits > 0 THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN ans < 20 THEN 0.15::DOUBLE ELSE 0 END AS s FROM x)"
query("EVA32_signal_confidence", f"{FLAG} SELECT doc_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(s * 0.6::DOUBLE + nli * 0.4::DOUBLE, s))), 6) AS value FROM y")(
    lambda t: t.documents.select("doc_id", E.signal_confidence(c("n_chars"), c("n_chars") * (c("doc_id") % 5), F.when(c("doc_id") % 3 != 0, (c("doc_id") % 10) / 10), c("doc_id") % 2).alias("value"))
)

# ---- claims against contexts: a document is an answer, the next one its context


def answers(t: Tables) -> DataFrame:
    d = t.documents
    own = d.select(c("doc_id").alias("id"), c("text").alias("answer"))
    return own.join(d.select((c("doc_id") - 1).alias("id"), c("text").alias("context")), "id")


W = r"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+'))"
CLAIM_SQL = rf"""WITH p AS (SELECT a.doc_id AS id, a.text AS text, b.text AS ctx, {W.format(x='b.text')} AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    k AS (SELECT id, b, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), '\n|;\s+', chr(1), 'g'), chr(1)),
        lambda p: trim(regexp_replace(regexp_replace(trim(p), '[;.]+$', ''), '^[-*•]\s*', ''))), lambda x: length(x) >= 10)) AS claim FROM p),
    w AS (SELECT id, claim, {W.format(x='claim')} AS a, b FROM k),
    s AS (SELECT id, claim, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * (len(list_intersect(a, b)) / sqrt(len(a)::DOUBLE * len(b))) + 0.5::DOUBLE * (len(list_intersect(a, b)) / len(a)::DOUBLE) END AS support FROM w)"""
query("EVA10_grounding", f"{CLAIM_SQL} SELECT id, count(*) AS total, count(*) FILTER (support >= 0.25::DOUBLE) AS supported, round(count(*) FILTER (support >= 0.25::DOUBLE) / count(*)::DOUBLE, 3) AS score FROM s GROUP BY 1")(lambda t: E.grounding(answers(t)))
query("EVA11_claim_report", f"{CLAIM_SQL} SELECT id, claim, support >= 0.25::DOUBLE AS supported FROM s")(lambda t: E.grounded_claims(answers(t), 0.25).select("id", "claim", "supported"))
query("EVA12_hallucination", f"{CLAIM_SQL} SELECT id, count(*) FILTER (support < 0.3::DOUBLE) AS unsupported, count(*) AS total FROM s GROUP BY 1")(lambda t: E.grounding(answers(t), 0.3).select("id", (c("total") - c("supported")).alias("unsupported"), "total"))
query("EVA12_hallucination_report")(lambda t: E.hallucinations(answers(t)).select("id", "rate", F.array_join("hallucinated", "\n").alias("hallucinated"), F.array_join("evidence", "\n").alias("evidence"), "total"))


def responses(t: Tables) -> DataFrame:
    """A document answers its own first 120 characters; the next two documents are the contexts."""
    d = t.documents.select("doc_id", "text")
    after = lambda n: d.select((c("doc_id") - n).alias("id"), c("text").alias(f"c{n}"))
    own = d.select(c("doc_id").alias("id"), F.substring("text", 1, 120).alias("question"), c("text").alias("answer"))
    return own.join(after(1), "id", "left").join(after(2), "id", "left").select("id", "question", "answer", F.array_compact(F.array("c1", "c2")).alias("contexts"))


KEYS = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in T.METRIC_STOP) + "))"
RESPONSES = "r AS (SELECT d.doc_id AS id, left(d.text, 120) AS question, d.text AS answer, list_filter([x.text, y.text], lambda z: z IS NOT NULL) AS contexts FROM documents d LEFT JOIN documents x ON x.doc_id = d.doc_id + 1 LEFT JOIN documents y ON y.doc_id = d.doc_id + 2)"
query(
    "EVA13_lexical_metrics",
    rf"""WITH {RESPONSES}, k AS (SELECT *, {KEYS.format(x='question')} AS q, {KEYS.format(x='answer')} AS a, {KEYS.format(x="array_to_string(contexts, ' ')")} AS ck, array_to_string(contexts, ' ') AS joined,
        list_filter(list_transform(string_split(answer, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 10) AS s FROM r),
    m AS (SELECT id, CASE WHEN coalesce(answer, '') = '' OR joined = '' THEN 0 WHEN len(s) = 0 THEN 1 ELSE len(list_filter(list_transform(s, lambda x: {KEYS.format(x='x')}), lambda y: len(y) > 0 AND len(list_intersect(y, ck)) / len(y)::DOUBLE >= 0.3::DOUBLE)) / len(s)::DOUBLE END::DOUBLE AS f,
        CASE WHEN coalesce(question, '') = '' OR coalesce(answer, '') = '' THEN 0 WHEN len(q) = 0 THEN 0.5 ELSE len(list_intersect(q, a)) / len(q)::DOUBLE END::DOUBLE AS a,
        CASE WHEN coalesce(question, '') = '' OR len(contexts) = 0 THEN 0 WHEN len(q) = 0 THEN 0.5 ELSE len(list_filter(contexts, lambda z: len(list_intersect(q, {KEYS.format(x='z')})) / len(q)::DOUBLE >= 0.3::DOUBLE)) / len(contexts)::DOUBLE END::DOUBLE AS c FROM k)
    SELECT id, round(f, 6) AS faithfulness, round(a, 6) AS answer_relevance, round(c, 6) AS context_relevance, round((f + a + c) / 3, 6) AS overall FROM m""",
)(lambda t: E.lexical_metrics(responses(t)))
CLAIMS_OF = r"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim({x}), '([.!?])\s+', '\1' || chr(1), 'g'), '\n|;\s+', chr(1), 'g'), chr(1)), lambda p: trim(regexp_replace(regexp_replace(trim(p), '[;.]+$', ''), '^[-*•]\s*', ''))), lambda x: length(x) >= 10)"""
query(
    "EVA14_lite_metrics",
    rf"""WITH {RESPONSES}, k AS (SELECT *, {W.format(x='question')} AS q, {W.format(x='answer')} AS a, {W.format(x="array_to_string(contexts, ' ')")} AS ck, array_to_string(contexts, ' ') AS joined, {CLAIMS_OF.format(x='answer')} AS s FROM r)
    SELECT id, round(CASE WHEN NOT regexp_matches(coalesce(answer, ''), '\S') OR NOT regexp_matches(joined, '\S') THEN 0 WHEN len(s) = 0 THEN 1
            ELSE len(list_filter(list_transform(s, lambda x: {W.format(x='x')}), lambda y: len(y) > 0 AND len(ck) > 0 AND len(list_intersect(y, ck)) / sqrt(len(y)::DOUBLE * len(ck)) * 0.5::DOUBLE + len(list_intersect(y, ck)) / len(y)::DOUBLE * 0.5::DOUBLE >= 0.3::DOUBLE)) / len(s)::DOUBLE END::DOUBLE, 4) AS faithfulness,
        round(CASE WHEN coalesce(answer, '') = '' OR coalesce(question, '') = '' THEN 0 WHEN len(q) = 0 THEN 0.5 ELSE len(list_intersect(q, a)) / len(q)::DOUBLE END::DOUBLE, 4) AS relevancy,
        round(CASE WHEN coalesce(answer, '') = '' OR len(a) = 0 OR len(contexts) = 0 THEN 0 ELSE len(list_filter(list_transform(contexts, lambda z: {W.format(x='z')}), lambda y: len(y) > 0 AND len(list_intersect(a, y)) / len(y)::DOUBLE >= 0.15::DOUBLE)) / len(contexts)::DOUBLE END::DOUBLE, 4) AS precision FROM k""",
)(lambda t: E.lite_metrics(responses(t)))
query(
    "EVA11_verification_report",
    rf"""WITH p AS (SELECT a.doc_id AS id, {CLAIMS_OF.format(x='a.text')} AS s, {W.format(x='b.text')} AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
    k AS (SELECT id, b, unnest(s) AS claim, generate_subscripts(s, 1) AS spot FROM p), w AS (SELECT *, {W.format(x='claim')} AS a FROM k),
    v AS (SELECT id, claim, spot, len(a) > 0 AND len(b) > 0 AND 0.5::DOUBLE * (len(list_intersect(a, b)) / sqrt(len(a)::DOUBLE * len(b))) + 0.5::DOUBLE * (len(list_intersect(a, b)) / len(a)::DOUBLE) >= 0.25::DOUBLE AS yes FROM w)
    SELECT p.id, round(coalesce(count(*) FILTER (yes) / nullif(count(claim), 0)::DOUBLE, 0), 3) AS rate, coalesce(string_agg(claim, chr(10) ORDER BY spot) FILTER (yes), '') AS supported,
        coalesce(string_agg(claim, chr(10) ORDER BY spot) FILTER (NOT yes), '') AS unsupported, count(claim)::INT AS total FROM p LEFT JOIN v USING (id) GROUP BY 1""",
)(lambda t: E.claim_report(answers(t)).select("id", "rate", F.array_join("supported", "\n").alias("supported"), F.array_join("unsupported", "\n").alias("unsupported"), "total"))
query("AGG32_hallucination_totals", f"{CLAIM_SQL} SELECT count(*) FILTER (support < 0.3::DOUBLE) AS unsupported, count(*) AS total, round(count(*) FILTER (support < 0.3::DOUBLE) / count(*)::DOUBLE, 6) AS rate FROM s")(
    lambda t: E.grounded_claims(answers(t), 0.3).agg(F.count_if(~c("supported")).alias("unsupported"), F.count("*").alias("total"), F.round(F.count_if(~c("supported")) / F.count("*"), 6).alias("rate"))
)
query(
    "EVA15_entailment",
    f"{CLAIM_SQL}, g AS (SELECT id, count(*) AS n, count(*) FILTER (support >= 0.4::DOUBLE) AS e, count(*) FILTER (support <= 0.15::DOUBLE) AS k FROM s GROUP BY 1) SELECT id, e AS entailed, k AS contradicted, n - e - k AS neutral, round(greatest(0.0::DOUBLE, e / n::DOUBLE - 0.5::DOUBLE * (k / n::DOUBLE)), 6) AS overall FROM g",
)(
    lambda t: E.grounded_claims(answers(t), 0.4).groupBy("id").agg(F.count("*").alias("n"), F.count_if(c("support") >= 0.4).alias("e"), F.count_if(c("support") <= 0.15).alias("k")).select(
        "id", c("e").alias("entailed"), c("k").alias("contradicted"), (c("n") - c("e") - c("k")).alias("neutral"), F.round(F.greatest(F.lit(0.0), c("e") / c("n") - F.lit(0.5) * (c("k") / c("n"))), 6).alias("overall")
    )
)
PHRASES = ["i don't know", "i'm not sure", "i cannot", "no information", "не знаю", "не уверен", "нет информации", "не могу", "unclear", "uncertain", "possibly", "maybe", "возможно", "вероятно", "неясно"]
query(
    "EVA09_answer_confidence",
    f"""{CLAIM_SQL}, g AS (SELECT id, round(count(*) FILTER (support >= 0.25::DOUBLE) / count(*)::DOUBLE, 3) AS nli FROM s GROUP BY 1),
    b AS (SELECT id, 0.7::DOUBLE - CASE WHEN length(trim(ctx)) < 20 THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN length(ctx) < length(text) * 0.5::DOUBLE THEN 0.2::DOUBLE ELSE 0 END
        - CASE WHEN {' OR '.join("contains(lower(text), '" + x.replace(chr(39), chr(39) * 2) + "')" for x in PHRASES)} THEN 0.2::DOUBLE ELSE 0 END - CASE WHEN length(trim(text)) < 20 THEN 0.15::DOUBLE ELSE 0 END AS s0 FROM p)
    SELECT id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * s0 + 0.4::DOUBLE * coalesce(nli, 0))), 6) AS score FROM b LEFT JOIN g USING (id)""",
)(
    lambda t: answers(t).join(E.grounding(answers(t)).select("id", c("score").alias("nli")), "id", "left").select(
        "id",
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.6) * (
            F.lit(0.7) - F.when(F.length(F.trim("context")) < 20, 0.4).otherwise(0.0) - F.when(F.length("context") < F.length("answer") * 0.5, 0.2).otherwise(0.0)
            - F.when(F.exists(F.array(*map(F.lit, PHRASES)), lambda p: F.lower(c("answer")).contains(p)), 0.2).otherwise(0.0) - F.when(F.length(F.trim("answer")) < 20, 0.15).otherwise(0.0)
        ) + F.lit(0.4) * F.coalesce("nli", F.lit(0.0)))), 6).alias("score"),
    )
)
PAIRS = rf"WITH p AS (SELECT a.doc_id AS id, {W.format(x='a.text')} AS a, {W.format(x='b.text')} AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"
pairs = lambda t: t.documents.select(c("doc_id").alias("id"), T.word_set(c("text")).alias("a")).join(t.documents.select((c("doc_id") - 1).alias("id"), T.word_set(c("text")).alias("b")), "id")
query("SET04_overlaps", f"{PAIRS} SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS jaccard, round(len(list_intersect(a, b)) / len(a)::DOUBLE, 6) AS containment, round(len(list_intersect(a, b)) / sqrt(len(a)::DOUBLE * len(b)), 6) AS cosine FROM p")(
    lambda t: pairs(t).select("id", F.round(T.jaccard(c("a"), c("b")), 6).alias("jaccard"), F.round(T.containment(c("a"), c("b")), 6).alias("containment"), F.round(T.set_cosine(c("a"), c("b")), 6).alias("cosine"))
)
query(
    "EVA17_relevance_classes",
    f"{PAIRS}, s AS (SELECT id // 5 AS g, least(1.0::DOUBLE, 0.4::DOUBLE * (len(list_intersect(a, b)) / len(a)::DOUBLE) + 0.6::DOUBLE * (len(list_intersect(a, b)) / sqrt(len(a)::DOUBLE * len(b)))) AS score FROM p), k AS (SELECT g, count(*) AS n, count(*) FILTER (score > 0.7::DOUBLE) AS good, count(*) FILTER (score < 0.3::DOUBLE) AS bad FROM s GROUP BY 1) SELECT g, good, bad, n - good - bad AS ambiguous, CASE WHEN good / n::DOUBLE >= 0.5 THEN 'Correct' WHEN good = 0 AND bad = n THEN 'Incorrect' ELSE 'Ambiguous' END AS class FROM k",
)(
    lambda t: pairs(t).select(F.floor(c("id") / 5).alias("g"), F.least(F.lit(1.0), F.lit(0.4) * T.containment(c("a"), c("b")) + F.lit(0.6) * T.set_cosine(c("a"), c("b"))).alias("score")).groupBy("g").agg(F.count("*").alias("n"), F.count_if(c("score") > 0.7).alias("good"), F.count_if(c("score") < 0.3).alias("bad")).select(
        "g", "good", "bad", (c("n") - c("good") - c("bad")).alias("ambiguous"), F.when(c("good") / c("n") >= 0.5, "Correct").when((c("good") == 0) & (c("bad") == c("n")), "Incorrect").otherwise("Ambiguous").alias("class")
    )
)
NEG = ["not", "no", "never", "none", "neither", "nor", "without", "cannot", "doesn"]
NEGS = "[" + ", ".join(f"'{x}'" for x in NEG) + "]"
query(
    "EVA20_contradictions",
    f"{PAIRS}, s AS (SELECT id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS j, (list_has_any(a, {NEGS})) <> (list_has_any(b, {NEGS})) AS one FROM p) SELECT id, CASE WHEN j > 0.4::DOUBLE AND one THEN 0.6::DOUBLE ELSE 0.05::DOUBLE END AS contradiction, CASE WHEN j > 0.4::DOUBLE AND one THEN 0.1::DOUBLE WHEN j > 0.6::DOUBLE THEN 0.7::DOUBLE ELSE 0.1::DOUBLE END AS entailment FROM s",
)(
    lambda t: pairs(t).withColumn("j", T.jaccard(c("a"), c("b"))).withColumn("one", F.arrays_overlap("a", F.array(*map(F.lit, NEG))) != F.arrays_overlap("b", F.array(*map(F.lit, NEG)))).select(
        "id", F.when((c("j") > 0.4) & c("one"), 0.6).otherwise(0.05).alias("contradiction"), F.when((c("j") > 0.4) & c("one"), 0.1).when(c("j") > 0.6, 0.7).otherwise(0.1).alias("entailment")
    )
)
query("EVA23_novel_words", r"WITH p AS (SELECT a.doc_id AS id, regexp_extract_all(lower(a.text), '[\p{L}\p{N}_]+') AS a, " + W.format(x="b.text") + r" AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) SELECT id, round(coalesce(len(list_filter(a, lambda x: NOT list_contains(b, x))) / nullif(len(a), 0)::DOUBLE, 0), 6) AS rate FROM p")(
    lambda t: E.novel_words(t.documents.select(c("doc_id").alias("id"), c("text").alias("answer")).join(t.documents.select((c("doc_id") - 1).alias("id"), c("text").alias("context")), "id"))
)
query("EVA24_perplexity", "SELECT event_type, round(exp(-avg(-value / 100)), 6) AS perplexity FROM events GROUP BY 1")(lambda t: t.events.groupBy("event_type").agg(F.round(F.exp(-F.avg(-c("value") / 100)), 6).alias("perplexity")))
query(
    "EVA16_calibrated",
    """WITH d AS (SELECT round(length(text) / 5000.0::DOUBLE, 3) AS score, quality AS label FROM documents JOIN labels USING (doc_id)), k AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM d GROUP BY 1),
    s AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, lead(score) OVER w AS nx, (SELECT sum(p) FROM k) AS ap FROM k WINDOW w AS (ORDER BY score DESC)), f AS (SELECT *, coalesce(2.0::DOUBLE * tp / (tp + fp + ap), 0) AS f1 FROM s),
    b AS (SELECT score, f1, 1 AS seen FROM f UNION ALL SELECT (score + nx) / 2, f1, 0 FROM f WHERE nx IS NOT NULL) SELECT round(score, 6) AS threshold, round(f1, 6) AS f1 FROM b ORDER BY f1 DESC, seen DESC, score LIMIT 1""",
)(lambda t: E.calibrated(t.documents.join(t.labels, "doc_id").select(F.round(F.length("text") / 5000, 3).alias("score"), c("quality").alias("label"))).select(F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1")))
query(
    "EVA28_split",
    """WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings)
    SELECT vec_id, CASE WHEN place < floor(n * 0.8::DOUBLE) THEN 'train' WHEN place < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS part FROM o""",
)(lambda t: A.seeded_split(t.embeddings.select("vec_id"), "vec_id", {"train": 0.8, "validation": 0.1, "test": 0.1}, 42))


@query(
    "entry_retrieval",
    f"""{LEVELS.replace('h AS (SELECT * FROM (SELECT *, row_number()', 'h AS (SELECT * FROM (SELECT *, row_number()')},
    kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r, count(*) OVER v AS n, min(score) OVER v AS lo, max(score) OVER v AS hi FROM l WINDOW v AS (PARTITION BY query_id)),
    ka AS (SELECT *, CASE WHEN n > 2 AND hi > lo THEN round(abs((r - 1) / (n - 1)::DOUBLE + (score - lo) / (hi - lo) - 1), 9) END AS away FROM kr),
    kx AS (SELECT query_id, greatest(2, first(r ORDER BY away DESC NULLS LAST, r)) AS knee FROM ka GROUP BY 1),
    ke AS (SELECT ka.query_id, ka.doc_id, ka.r FROM ka JOIN kx USING (query_id) WHERE r <= CASE WHEN n <= 2 THEN n WHEN hi = lo THEN greatest(2, n // 2) ELSE knee END),
    rel AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, count(*) AS kept, count(rel.doc_id) AS relevant FROM ke LEFT JOIN rel USING (query_id, doc_id) GROUP BY 1""",
)
def entry_retrieval(t: Tables) -> DataFrame:
    """Dense search, score levels, knee pruning, and how many kept hits are relevant."""
    kept = R.knee(R.threshold(shifted(t)))
    v = vectors(t)
    return E.class_hits(kept, v.where(c("id") % 20 == 0), v).groupBy("query_id").agg(F.count("*").alias("kept"), F.count_if("hit").alias("relevant"))


LIMITS = [("click", ">=", 0.5, "fail"), ("error", "<=", 0.4, "warn"), ("purchase", ">", 0.495, "fail"), ("view", ">=", 0.9, "warn"), ("absent", ">=", 0.1, "fail")]
LIMITS_SQL = "l AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{s}', {x}::DOUBLE, '{y}')" for m, s, x, y in LIMITS) + ") AS t(metric, comparison, threshold, severity))"
GATE_SQL = """j AS (SELECT m.metric, m.value, severity, CASE comparison WHEN '>=' THEN m.value >= threshold WHEN '>' THEN m.value > threshold WHEN '<=' THEN m.value <= threshold WHEN '<' THEN m.value < threshold ELSE true END AS passed, m.value - b.value AS delta
        FROM m LEFT JOIN l USING (metric) LEFT JOIN b USING (metric)),
    w AS (SELECT *, coalesce(severity = 'fail' AND delta < -0.02::DOUBLE, false) AS regressed FROM j),
    g AS (SELECT *, CASE WHEN NOT passed AND severity = 'fail' THEN 3 WHEN NOT passed OR regressed THEN 2 ELSE 1 END AS worst FROM w)
    SELECT metric, round(value, 6) AS value, passed, round(delta, 6) AS delta, regressed, (['PASS', 'WARN', 'FAIL'])[worst] AS status, (['PASS', 'WARN', 'FAIL'])[(SELECT max(worst) FROM g)] AS overall FROM g"""
rounded = lambda df: df.select("metric", F.round("value", 6).alias("value"), "passed", F.round("delta", 6).alias("delta"), "regressed", "status", "overall")
mean_of = lambda df: df.groupBy(c("event_type").alias("metric")).agg((F.avg("value") / 100).alias("value"))
limits = lambda t, more=(): t.spark.createDataFrame([*LIMITS, *more], "metric string, comparison string, threshold double, severity string")
query(
    "EVA25_gate_with_baseline",
    f"WITH m AS (SELECT event_type AS metric, avg(value) / 100 AS value FROM events GROUP BY 1), b AS (SELECT event_type AS metric, avg(value) / 100 AS value FROM events WHERE event_id % 7 = 0 GROUP BY 1), {LIMITS_SQL}, {GATE_SQL}",
)(lambda t: rounded(E.gate(mean_of(t.events), limits(t), mean_of(t.events.where("event_id % 7 = 0")))))


ANSWERED = f"""a AS (SELECT * FROM ({ORACLE_SQL['EVA14_lite_metrics']})), n AS (SELECT avg((support >= 0.4::DOUBLE)::INT) AS value FROM ({CLAIM_SQL} SELECT support FROM s)),
    m AS (SELECT event_type AS metric, avg(value) / 100 AS value FROM events GROUP BY 1 UNION ALL SELECT 'ragas_faithfulness', avg(faithfulness) FROM a UNION ALL SELECT 'ragas_relevancy', avg(relevancy) FROM a
        UNION ALL SELECT 'ragas_precision', avg(precision) FROM a UNION ALL SELECT 'nli_entailment', value FROM n)"""
MORE = [("ragas_faithfulness", ">=", 0.5, "fail"), ("ragas_relevancy", ">=", 0.5, "warn"), ("ragas_precision", ">=", 0.5, "warn"), ("nli_entailment", ">=", 0.3, "fail")]
MORE_SQL = LIMITS_SQL.replace(") AS t(", ", " + ", ".join(f"('{m}', '{s}', {x}::DOUBLE, '{y}')" for m, s, x, y in MORE) + ") AS t(")


@query("EVA35_gate_with_answers", f"WITH {ANSWERED}, b AS (SELECT event_type AS metric, avg(value) / 100 AS value FROM events WHERE event_id % 7 = 0 GROUP BY 1), {MORE_SQL}, {GATE_SQL}")
def answer_gate(t: Tables) -> DataFrame:
    """The gate with answers' metrics beside the others: mean lexical metrics, and mean entailment of claims."""
    lite = E.lite_metrics(responses(t)).agg(*[F.avg(x).alias(x) for x in ("faithfulness", "relevancy", "precision")])
    ragas = lite.select(F.explode(F.array(*[F.struct(F.lit(f"ragas_{x}").alias("metric"), c(x).alias("value")) for x in lite.columns])).alias("x")).select("x.*")
    entailed = E.grounded_claims(answers(t), 0.4).agg(F.lit("nli_entailment").alias("metric"), F.avg(c("supported").cast("double")).alias("value"))
    return rounded(E.gate(mean_of(t.events).unionByName(ragas).unionByName(entailed), limits(t, MORE), mean_of(t.events.where("event_id % 7 = 0"))))
