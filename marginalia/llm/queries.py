"""The queries of this subpackage, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, jaccard, langid, line_dedup, near_vectors, nbest, periodic_runs, quality, suffix_dedup, token_counts, token_store, whitening
from .common import new_path, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.encoded(table(spark, sf_dir, "documents"), PIECE_BPE, with_ids=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return langid.language_id(table(spark, sf_dir, "documents"), held_out)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, BYTE_BPE)
    return token_store.read_digests(spark, path, BYTE_BPE)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True, with_texts=False).drop("runs", "collapsed")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_nbest": op1_sentencepiece_nbest,
    "op2_language_id": op2_language_id,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_token_store": op4_token_store,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_near_vectors": op11_near_vectors,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op5_jaccard_join": r"""
        WITH RECURSIVE t AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
            FROM t
        ), n AS (
            SELECT r, count(*) AS n FROM s GROUP BY r
        ), p AS (
            SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2
        ), l AS (
            SELECT x, y FROM p JOIN n nx ON nx.r = x JOIN n ny ON ny.r = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
        ), e AS MATERIALIZED (
            SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l
        ), reach AS (
            SELECT r, r AS q FROM t UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.q = e.a
        ), c AS (
            SELECT reach.r, min(t.doc_id) AS component_id FROM reach JOIN t ON t.r = reach.q GROUP BY reach.r
        )
        SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM t JOIN c USING (r) LEFT JOIN n USING (r)""",
    "op8_line_dedup": """
        WITH s AS MATERIALIZED (
            SELECT doc_id, row_number() OVER () AS row_no, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), l AS (
            SELECT doc_id, row_no, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM s
        ), k AS (
            SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
        ), f AS (
            SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'none')) >= 10
        ), m AS (
            SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key)
        )
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY row_no""",
    "op10_suffix_dedup": """
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS row_no, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), i AS (
            SELECT row_no, doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS pos FROM d
        ), w AS (
            SELECT row_no, doc_id, pos, substr(h, 2 * pos + 1, 100) AS s FROM i
        ), f AS (
            SELECT s, min(doc_id) AS first_id FROM w GROUP BY s
        ), g AS (
            SELECT DISTINCT row_no, pos FROM w JOIN f USING (s) WHERE first_id < coalesce(doc_id, 9223372036854775807)
        ), b AS (
            SELECT *, coalesce(pos > lag(pos) OVER (PARTITION BY row_no ORDER BY pos) + 50, true) AS begins FROM g
        ), n AS (
            SELECT *, sum(begins::INT) OVER (PARTITION BY row_no ORDER BY pos) AS span FROM b
        ), r AS (
            SELECT row_no, span, min(pos) AS a, max(pos) + 50 AS z FROM n GROUP BY row_no, span
        ), k AS (
            SELECT r.*, coalesce(lag(z) OVER (PARTITION BY row_no ORDER BY a), 0) AS before FROM r
        ), t AS (
            SELECT row_no, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last,
                   string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
            FROM k JOIN d USING (row_no) GROUP BY row_no
        )
        SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN t USING (row_no)""",    "op11_near_vectors": """
        WITH RECURSIVE t AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
        ), u AS MATERIALIZED (
            SELECT r, label, v, sqrt(list_inner_product(v, v)) AS norm FROM t
            WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(v, lambda x: x <> 0)) > 0
        ), e AS MATERIALIZED (
            SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
            WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
        ), n AS (
            SELECT x AS r, count(*) AS n FROM e GROUP BY x
        ), reach AS (
            SELECT r, r AS q FROM t UNION SELECT reach.r, e.y FROM reach JOIN e ON reach.q = e.x
        ), c AS (
            SELECT reach.r, min(t.vec_id) AS component_id FROM reach JOIN t ON t.r = reach.q GROUP BY reach.r
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
        FROM t JOIN c USING (r) LEFT JOIN n USING (r)""",
}
