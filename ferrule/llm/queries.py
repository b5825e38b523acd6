"""The queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, byte_bpe, fingerprint, language_id, near_dedup, packing, quality, sharding, topk, url_filter

WORD_VOCABULARY, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"
SHARDS, SHARD_SEED = 8, 20
TOKEN_END, PACK_END, CAPACITY = 1, 0, 2048
RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, quality.train(docs, labels), F.col("source"), F.col("lang"))


def op2_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _documents(spark, sf_dir).select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.interleave(docs, ["doc_id"], "source", SHARDS, SHARD_SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_chosen_path_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), width=4, similarity=0.8)


def op4_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bitplane.token_files(_documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY), TOKEN_END)
    return bitplane.read_digests(spark, path)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = language_id.train(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_id.predict(docs, model).alias("_l"))
    return found.select("doc_id", "held_out", F.col("_l.lang_pred").alias("lang_pred"), F.col("_l.score").alias("score"))


def op6_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY), PACK_END, CAPACITY)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


def op9_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_documents(spark, sf_dir))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter.judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_site_quality, op2_stratified_shards, op3_chosen_path_duplicates, op4_plane_files, op5_language,
        op6_residual_packing, op7_byte_bpe, op8_exact_topk, op9_multiset_fingerprints, op10_url_rules,
    )
}

ORACLE_SQL: dict[str, str] = {
    # The crc32 table follows from its polynomial, 0xEDB88320.
    "op2_stratified_shards": """
        WITH table_bits AS (
            SELECT list(c ORDER BY n) AS t FROM (
                SELECT n, list_reduce(list_concat([CAST(n AS UBIGINT)], list_transform(range(8), lambda k: CAST(0 AS UBIGINT))),
                    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS c
                FROM range(256) r(n)
            )
        ), bytes AS (
            SELECT doc_id, source, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size,
                list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST(CAST('0x' || h AS INTEGER) AS UBIGINT)) AS b
            FROM documents
        ), docs AS (
            SELECT doc_id, source, size,
                CAST(xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) % 256 + 1 AS BIGINT)])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32
            FROM bytes, table_bits
        ), hashed AS (
            SELECT *, CAST('0x' || substr(md5(concat_ws('|', '20', coalesce(CAST(doc_id AS VARCHAR), chr(0)), coalesce(source, chr(0)), size, text_crc32)), 1, 15) AS BIGINT) AS h FROM docs
        ), ranked AS (
            SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS f
            FROM hashed
        ), placed AS (
            SELECT *, row_number() OVER (ORDER BY f, source NULLS FIRST, h, doc_id NULLS FIRST, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM ranked
        ), cut AS (SELECT *, ((place + 1) * 8 - 1) // total AS k FROM placed)
        SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(k AS INTEGER) AS shard, CAST(place - (k * total) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM cut
    """,
    "op3_chosen_path_duplicates": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents
        ), shingles AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
                WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
            FROM words
        ), classes AS (
            SELECT min(doc_id) AS rep, list_sort(s) AS s, len(s) AS n FROM shingles WHERE len(s) > 0 GROUP BY list_sort(s), len(s)
        ), tokens AS (SELECT rep, n, unnest(s) AS t FROM classes),
        pairs AS (
            SELECT a.rep AS a, b.rep AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
            FROM tokens a JOIN tokens b ON a.t = b.t AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.rep, b.rep
        ), links AS (
            SELECT a, b FROM pairs WHERE 100 * common >= 80 * (na + nb - common)
            UNION ALL SELECT b, a FROM pairs WHERE 100 * common >= 80 * (na + nb - common)
        ), reached AS (
            SELECT rep AS id, rep AS other FROM classes
            UNION SELECT r.id, l.b FROM reached r JOIN links l ON r.other = l.a
        ), least_of AS (SELECT id, min(other) AS component FROM reached GROUP BY id)
        SELECT x.doc_id, CAST(len(x.s) AS BIGINT) AS n_shingles, coalesce(l.component, x.doc_id) AS component_id, coalesce(l.component, x.doc_id) = x.doc_id AS kept
        FROM shingles x LEFT JOIN classes c ON c.s = list_sort(x.s) LEFT JOIN least_of l ON l.id = c.rep
    """,
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op10_url_rules": """
        WITH cut AS (
            SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
        ), hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut),
        parts AS (
            SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
            FROM hosts
        ), rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT p.*, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST) AS n
            FROM parts p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
        )
        SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM fits WHERE n = 1
    """,
}
