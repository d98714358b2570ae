"""Registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import elkan, fm, katz, lines, minhash, packing, rlz, rules, secrets, tokenizing, transport, trie
from .common import conversations, documents, embeddings, labels


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.media_features(documents(spark, sf_dir))


def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))


def op3_b_bit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), k=4, percent=80)


def op4_secret_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op5_pack_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), word_bpe())


def op6_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.encode_decode(documents(spark, sf_dir), word_bpe())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizing.count_tokens(documents(spark, sf_dir), byte_bpe())


def op8_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir))


def op9_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.kept_words(documents(spark, sf_dir))


def op10_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.kept_lines(documents(spark, sf_dir))


def op12_elkan_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.compressed(embeddings(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(conversations(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_transport_stream,
        op2_risk_controlled_rules,
        op3_b_bit_minhash,
        op4_secret_novelty,
        op5_pack_ordered,
        op6_bpe_segment_tree,
        op7_token_counts,
        op8_katz_backoff,
        op9_relative_lempel_ziv,
        op10_factorisation_machine,
        op11_line_dedup,
        op12_elkan_codes,
        op13_prefix_trie,
    )
}

#: Words of each whole text, as the contract splits them.
WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op3_b_bit_minhash": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, {WORDS_SQL} AS w
            FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
        ),
        s AS (
            SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1))::BIGINT AS i FROM d WHERE len(w) > 0)
        ),
        n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = doc_id GROUP BY doc_id
    """,
    "op9_relative_lempel_ziv": f"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS_SQL} AS w FROM documents),
        p AS (SELECT r, w, unnest(range(1, greatest(1, len(w) - 33)))::BIGINT AS i FROM d),
        v AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
        t AS (SELECT h FROM v GROUP BY h HAVING count(*) > 1),
        g AS (SELECT DISTINCT r, i + k AS i FROM v SEMI JOIN t USING (h), range(35) AS s(k)),
        e AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1))::BIGINT AS i FROM d),
        k AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM e ANTI JOIN g USING (r, i) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (r)
    """,
    "op11_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, r, unnest(s) AS line, unnest(range(1, len(s) + 1))::BIGINT AS i
            FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
        ),
        k AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ),
        f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id <> last)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
        FROM k LEFT JOIN f USING (key) GROUP BY doc_id, r
    """,
    "op12_elkan_codes": """
        WITH k AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        p AS (SELECT vec_id, label, part, q[part * (len(q) // 16) + 1:(part + 1) * (len(q) // 16)] AS v FROM k, range(16) AS t(part)),
        c0 AS (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p
            WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 64)
        ),"""
    + "".join(
        f"""
        a{i} AS (
            SELECT vec_id, label, p.part, p.v, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + e) AS x
            FROM p JOIN c{i} c ON p.part = c.part GROUP BY ALL
        ),"""
        + (
            f"""
        m{i} AS (
            SELECT part, e, list(floor(s / n)::BIGINT ORDER BY j) AS v
            FROM (SELECT part, x % 64 AS e, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, 257) AS t(j) WHERE j <= len(v) GROUP BY part, x % 64, j) GROUP BY part, e
        ),
        c{i + 1} AS (SELECT part, e, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (part, e)),"""
            if i < 2
            else ""
        )
        for i in range(3)
    )
    + """
        r AS (SELECT vec_id, label, string_agg(printf('%02x', x % 64), '' ORDER BY part) AS code, sum(x // 64)::BIGINT AS error FROM a2 GROUP BY vec_id, label)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM c2) AS codebooks_sha256
        FROM r
    """,
    "op13_prefix_trie": """
        WITH t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
                   coalesce(role, '') AS role, coalesce(text, '') AS text
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        c AS (
            -- crc32 of the decimal id, bit by bit
            SELECT conv_id, conv_id - conv_id % 100 AS base,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                       lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h
            FROM (SELECT DISTINCT conv_id FROM t)
        ),
        u AS (
            SELECT c.conv_id, 0 AS own, i, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i <= h
            UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > h
        ),
        s AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY own, i) AS s FROM u GROUP BY conv_id),
        f AS (SELECT conv_id, coalesce(s, []) AS s FROM c LEFT JOIN s USING (conv_id)),
        m AS (
            SELECT conv_id, d, CASE WHEN d = 0 THEN '' ELSE md5(s[1:d]::VARCHAR) END AS k, CASE WHEN d > 0 THEN CASE WHEN d = 1 THEN '' ELSE md5(s[1:d - 1]::VARCHAR) END END AS up,
                   CASE WHEN d = 0 THEN 0 ELSE length(s[d].t) END AS size, d = len(s) AS last
            FROM (SELECT conv_id, s, unnest(range(len(s) + 1))::BIGINT AS d FROM f)
        ),
        n AS (
            SELECT d, k, up, min(conv_id) AS least, count(*) AS n, any_value(size) AS size, bool_and(last) AS leaf,
                   sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends
            FROM m GROUP BY d, k, up
        ),
        -- a node's subtree: the nodes on the paths of its members, at its depth or below
        b AS (
            SELECT d, k, count(*) FILTER (leaf) AS leaves, sum((n - 1) * size) AS saved
            FROM (SELECT DISTINCT a.d, a.k, x.d AS d2, x.k AS k2 FROM m a JOIN m x ON a.conv_id = x.conv_id AND x.d >= a.d) JOIN (SELECT d AS d2, k AS k2, n, size, leaf FROM n) USING (d2, k2)
            GROUP BY d, k
        )
        SELECT n.least AS conv_id, n.d AS depth, p.least AS parent_conv_id, n.n::BIGINT AS n_convs,
               (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.up = n.k)::BIGINT AS n_children,
               b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
        FROM n JOIN b ON b.d = n.d AND b.k = n.k LEFT JOIN n p ON p.d = n.d - 1 AND p.k = n.up
    """,
}
