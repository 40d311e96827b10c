"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import ann, bpe, chat, line_dedup, mixing, near_dup, quality, substring_dedup, telephony, token_counts
from tracewell.llm._common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sha256 = lambda x: hashlib.sha256(x).hexdigest()
    digests = {"ids_sha256": ("ids", sha256), "decoded_sha256": ("decoded", sha256)}
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_decoded=True, derive=digests)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.deduplicated(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, ann.fit(vectors), F.col("vec_id") % 50 == 0)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.find_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = telephony.round_trip(table(spark, sf_dir, "documents"), rate=16_000)
    tail = F.substring("payload", -32, 32)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"),
    )


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_token_counts, op3_line_dedup, op4_ann, op5_substring_dedup, op6_quality, op7_telephony, op8_near_dup, op9_mixing, op10_chat)
}
ORACLE_SQL = {
    "op3_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
        ), keyed AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM lines
        ), hot AS (
            SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
            GROUP BY k HAVING count(DISTINCT doc_id) >= 5
        ), judged AS (
            SELECT keyed.*, hot.k IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN hot ON keyed.k = hot.k
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op5_substring_dedup": r"""
        WITH docs AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)
        ), firsts AS (
            SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING min(doc_id) < max(doc_id)
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (k) WHERE doc_id > first
        ), words AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id
        ), gone AS (
            SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM docs LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op8_near_dup": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), items AS (
            SELECT DISTINCT doc_id, item FROM (
                SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS item
                FROM docs)
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.item = b.item AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
            SELECT a, b, x.n = shared.n AND y.n = shared.n AS same
            FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE shared.n >= 0.8 * (x.n + y.n - shared.n)
        ), reached AS (
            SELECT doc_id, doc_id AS root FROM documents
            UNION
            SELECT links.a, reached.root FROM links JOIN reached ON links.b = reached.doc_id
        ), classes AS (
            SELECT doc_id, min(root) AS class_id FROM reached GROUP BY doc_id
        ), counts AS (
            SELECT a AS doc_id, count(*) AS n, CAST(sum(CAST(same AS INT)) AS BIGINT) AS copies FROM links GROUP BY a
        )
        SELECT doc_id, class_id, coalesce(n, 0) AS n_links, coalesce(copies, 0) AS n_copies FROM classes LEFT JOIN counts USING (doc_id)
    """,
    "op9_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS place
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size) * 2.0::DOUBLE AS cap,
                   [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
            FROM sized GROUP BY source
        ), ordered AS (
            SELECT *, cap / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total,
                   coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
                   sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest
            FROM sources
        ), levels AS (
            SELECT *, max(CASE WHEN (total - clamped) / rest <= ratio THEN (total - clamped) / rest END) OVER () AS level FROM ordered
        ), goals AS (
            SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM levels
        ), parts AS (
            SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals
        )
        SELECT doc_id, size, source_size, target,
               CAST(whole * size + greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - whole * source_size
                    - (sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size))) AS BIGINT) AS taken
        FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
    """,
}
