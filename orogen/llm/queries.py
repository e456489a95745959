"""The corpus queries: operators with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import bpe, languages, licenses, line_dedup, ngram_join, packing, periodic, pii, prefix_trie, quality, token_files, topk, toxicity
from orogen.llm.common import documents
from orogen.session import ship


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir))


def op2_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.find(docs, pii.fit(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op3_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted", "evidence", "n_tokens", "passages")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op7_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.dedup(documents(spark, sf_dir), least_docs=10)
    return got.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(documents(spark, sf_dir))


def op11_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return languages.identify(docs, languages.fit(docs))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.shared_starts(prefix_trie.turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic.find(documents(spark, sf_dir), loops=True)
    return got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _shipped(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        op1_bpe_round_trip, op2_skip_chain_pii, op3_license_patience, op4_best_fit_packing, op5_toxic_segments, op6_token_files, op7_segment_topk,
        op8_quality_ratio, op9_line_dedup, op10_ngram_jaccard, op11_language_filters, op12_prefix_trie, op13_periodic_runs,
    )
}


def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text: eight shifts for each character."""
    bits = "list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda t, z: xor(t >> 1, 3988292384 * (t & 1)))"
    return f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda acc, b: {bits}))"


ORACLES = {
    "op7_segment_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
        FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "op9_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
            FROM documents),
        keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM lines),
        often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o USING (key))
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
        edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
        SELECT sets.doc_id, len(s) AS n_shingles, m.c AS component_id
        FROM sets JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = sets.doc_id""",
    "op12_prefix_trie": rf"""
        WITH RECURSIVE said AS (
            SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        hashed AS (
            SELECT c, turn, sha256(concat(length(role), ':', role, ':', text)) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM said),
        own AS (SELECT c, d, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS i FROM hashed),
        ids AS (SELECT DISTINCT c, c - c % 20 AS base, {_crc32("CAST(c AS VARCHAR)")} % 4 AS h FROM own),
        pieces AS (
            SELECT ids.c, 0 AS later, own.i, d, words FROM ids JOIN own ON own.c = base AND i <= h
            UNION ALL SELECT ids.c, 1, own.i, d, words FROM ids JOIN own ON own.c = ids.c AND i > h),
        rebuilt AS (SELECT c, d, words, row_number() OVER (PARTITION BY c ORDER BY later, i) AS i FROM pieces),
        path AS (
            SELECT c, CAST(0 AS BIGINT) AS depth, '' AS k, CAST(NULL AS VARCHAR) AS pk, CAST(0 AS BIGINT) AS words FROM ids
            UNION ALL SELECT p.c, r.i, sha256(p.k || r.d), p.k, r.words FROM path p JOIN rebuilt r ON r.c = p.c AND r.i = p.depth + 1),
        nodes AS (SELECT depth, k, any_value(pk) AS pk, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM path GROUP BY depth, k),
        kids AS (SELECT pk, count(*) AS n_children FROM nodes WHERE pk IS NOT NULL GROUP BY pk),
        own_sums AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN n.depth > 0 THEN (n_convs - 1) * n.words ELSE 0 END AS saved
            FROM nodes n LEFT JOIN kids ON kids.pk = n.k),
        sums AS (
            SELECT p.k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM own_sums s JOIN path p ON p.c = s.conv_id AND p.depth <= s.depth GROUP BY p.k),
        ends AS (
            SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256
            FROM (SELECT c, k FROM path QUALIFY row_number() OVER (PARTITION BY c ORDER BY depth DESC) = 1) GROUP BY k)
        SELECT s.conv_id, s.depth, up.conv_id AS parent_conv_id, s.n_convs, s.n_children, CAST(sums.n_leaves AS BIGINT) AS n_leaves,
               CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
        FROM own_sums s JOIN sums ON sums.k = s.k LEFT JOIN nodes up ON up.k = s.pk LEFT JOIN ends ON ends.k = s.k""",
    "op13_periodic_runs": rf"""
        WITH split AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
        cut AS (SELECT *, len(w) AS n, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM split),
        looped AS (
            SELECT r, doc_id, n, CASE WHEN n > 0 AND h % 10 = 0
                THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM cut),
        windows AS (SELECT r, n, i, hash(w[i + 1:i + 16]) AS x FROM (SELECT r, n, w, unnest(range(n - 15)) AS i FROM looped)),
        periods AS (
            SELECT DISTINCT a.r, b.i - a.i AS q FROM (SELECT * FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1) a
            JOIN windows b ON a.r = b.r AND a.x = b.x AND a.i < b.i AND 3 * (b.i - a.i) <= a.n),
        same AS (
            SELECT r, q, i FROM (SELECT p.r, q, w, unnest(range(n - q)) AS i FROM periods p JOIN looped USING (r)) WHERE w[i + 1] = w[i + q + 1]),
        islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same),
        found AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
        runs AS (SELECT r, s, l, min(q) AS q FROM found GROUP BY r, s, l),
        told AS (
            SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS listed FROM runs GROUP BY r),
        best AS (
            SELECT a.* FROM runs a WHERE NOT EXISTS (
                SELECT 1 FROM runs b WHERE b.r = a.r AND (b.l * a.q > a.l * b.q OR (b.l * a.q = a.l * b.q AND (b.s < a.s OR (b.s = a.s AND b.q < a.q)))))),
        gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
        kept AS (
            SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM (SELECT r, unnest(w) AS x, unnest(range(n)) AS i FROM looped) ANTI JOIN gone USING (r, i) GROUP BY r)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
               sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
        FROM looped LEFT JOIN told USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)""",
}
