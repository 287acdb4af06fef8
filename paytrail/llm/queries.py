"""One query for each operator, over its whole table, with production parameters, and SQL where that can state the result."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paytrail.llm import anomalies, archives, audit, automaton, bpe, credentials, dedup, katz, middle, pieces, segments, severity, slots
from paytrail.sources.scratch import scratch_dir

BPE_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
UNIGRAM_VOCABULARY = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that every executor reaches."""
    return f"{scratch_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def hex256(x: Column) -> Column:
    return F.sha2(x, 256)


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.shard_documents(table(spark, sf_dir, "documents"), 24, folder(spark, "slot-map"))


def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents"))


def contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = automaton.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = automaton.hit_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), hex256(F.array_join("items", ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(UNIGRAM_VOCABULARY))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity.score(docs, severity.learn(docs, table(spark, sf_dir, "labels")))


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.scan(table(spark, sf_dir, "documents"))
    base = tuple(r.kind for r in credentials.BASE)
    return found.select(
        "doc_id",
        *[credentials.span_count(k).alias(f"n_{k}") for k in base],
        hex256(credentials.span_text(kinds=base)).alias("base_sha256"),
        credentials.span_text().alias("spans"),
    )


def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_VOCABULARY), public_tokenizers.PATTERN, body="body")
    told = F.array_join(F.col("ids").cast("array<string>"), ",")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), hex256(told).alias("ids_sha256"), hex256(F.col("body")).alias("decoded_sha256"))


def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return katz.score(table(spark, sf_dir, "documents"), F.crc32(key) % 7 == 2)


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, out = folder(spark, "arc"), folder(spark, "warc")
    archives.write_arc(table(spark, sf_dir, "pages"), arc)
    archives.convert(spark, arc, out)
    return archives.captures(spark, out)


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomalies.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = middle.restore(middle.transform(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n", "form", middle.prefix_chars().alias("prefix_chars"), middle.middle_chars().alias("middle_chars"), hex256(F.col("output")).alias("output_sha256"), hex256(F.col("restored")).alias("restored_sha256")
    )


def filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_sharding": sharding,
    "op2_topk": topk,
    "op3_near_duplicates": near_duplicates,
    "op4_decontamination": contamination,
    "op5_token_counts": token_counts,
    "op6_toxicity": toxicity,
    "op7_secrets": secrets,
    "op8_byte_bpe": byte_pairs,
    "op9_language_model": language_model,
    "op10_warc": warc,
    "op11_quality": quality,
    "op12_fill_in_middle": fill_in_middle,
    "op13_filter_audit": filter_audit,
}

ORACLES = {
    "op2_topk": """
        WITH clean AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM clean q JOIN clean c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op3_near_duplicates": """
        WITH RECURSIVE tokens AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM tokens
        ), flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) AS nx, any_value(b.n) AS ny
            FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), linked AS (SELECT x, y FROM shared WHERE 100 * k >= 75 * (nx + ny - k)),
        edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x),
        least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM q)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM r
    """,
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
        h AS (
            SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u,
                CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d
        ), c AS (
            SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
        ), p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_filter_audit": """
        WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
        l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
        f AS (
            SELECT part, CASE WHEN len(words) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS fails,
                coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
            FROM w LEFT JOIN l USING (doc_id)
        ), g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
        o(p, rest) AS (SELECT '', 'ABCDE' UNION ALL SELECT p || rest[i], replace(rest, rest[i], '') FROM (SELECT p, rest, unnest(range(1, len(rest) + 1)) AS i FROM o WHERE rest <> '')),
        s AS (SELECT p AS filter_order, unnest(range(1, 6)) AS step FROM o WHERE rest = ''),
        x AS (
            SELECT part, filter_order, step, good, toxic, n, fails, filter_order[step] AS letter, contains(fails, filter_order[step]) AS bad,
                translate(fails, filter_order[1:step], '') = fails AS kept, translate(fails, filter_order[1:step - 1], '') = fails AS here
            FROM g, s
        ), r AS (
            SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (kept), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (bad AND here), 0) AS BIGINT) AS removed,
                CAST(coalesce(sum(n) FILTER (bad AND NOT here), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (fails = letter), 0) AS BIGINT) AS unique_fails,
                CAST(coalesce(sum(n) FILTER (bad AND here AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (bad AND here AND toxic), 0) AS BIGINT) AS toxic_lost
            FROM x GROUP BY ALL
        )
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM r
    """,
}
