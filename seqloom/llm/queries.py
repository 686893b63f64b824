"""The corpus queries by name, over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import read
from seqloom.llm.html import extract
from seqloom.llm.language import identify
from seqloom.llm.lexical import ranked
from seqloom.llm.negatives import hard_negatives
from seqloom.llm.packing import pack_documents
from seqloom.llm.pieces import sampled_digest
from seqloom.llm.quality import THRESHOLD, held_out, train, with_score
from seqloom.llm.rules import quality_rules
from seqloom.llm.secrets import secret_findings
from seqloom.llm.simhash import simhash_groups
from seqloom.llm.topk import NEIGHBOURS, nearest_codes, sign_codes
from seqloom.llm.urls import judge
from seqloom.llm.vectors import near_vectors
from seqloom.plans.session import write_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: lang is what they declare, source their host."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    told = identify(docs, F.col("text"), F.col("lang"), F.col("source"))
    return told.select(
        "doc_id",
        F.col("lang").alias("declared"),
        F.col("lid.language").alias("language"),
        F.round("lid.posterior", 6).alias("posterior"),
        F.col("lid.letters").alias("letters"),
        F.col("lid.accepted").alias("kept"),
    )


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: their markup declares a language and their url has suffix and host."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|<[^>]*>", " ")
    declared = F.regexp_extract(html, r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z-]+)""", 1)
    told = identify(pages, text, declared, F.col("url"))
    return told.select(
        "page_id",
        "url",
        F.col("lid.language").alias("language"),
        F.round("lid.posterior", 6).alias("posterior"),
        F.col("lid.accepted").alias("kept"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(read(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all, by the signs of its components."""
    codes = write_table(sign_codes(read(spark, sf_dir, "embeddings")), "topk-codes")
    return nearest_codes(codes, codes.where("id % 100 = 0"))


OP3_SQL = f"""
WITH codes AS (
    SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(x > 0 AS INT)) AS code FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
), pairs AS (
    SELECT q.id AS query_id, c.id AS neighbour_id,
           CAST(list_sum(list_transform(list_zip(q.code, c.code), lambda z: CAST(z[1] <> z[2] AS INT))) AS BIGINT) AS distance
    FROM codes q JOIN codes c ON q.id <> c.id AND q.id % 100 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs
)
SELECT query_id, neighbour_id, distance, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= {NEIGHBOURS}
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


OP6_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
      AND list_sum(list_transform(embedding, lambda x: CAST(abs(x) AS DOUBLE))) > 0
), pairs AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(src, dst) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT r.src, p.b FROM reach r JOIN pairs p ON r.dst = p.a
), component AS (
    SELECT src, min(dst) AS component_id FROM reach GROUP BY src
), degree AS (
    SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component ON src = e.vec_id LEFT JOIN degree ON degree.a = e.vec_id
"""


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = sampled_digest(read(spark, sf_dir, "documents"))
    return digest.select(F.col("id").alias("doc_id"), "n_pieces", "ids_crc32", "lossless")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = with_score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, every seventh with the next label."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END").alias("label"))
    return hard_negatives(rows).select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        "rank",
        F.col("negative").alias("negative_id"),
        "positive_score",
        "negative_score",
    )


OP11_SQL = """
WITH v AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
), scored AS (
    SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
    FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
), positives AS (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE same
), ranked AS (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
    FROM positives p JOIN scored n ON p.place <= 5 AND p.anchor_id = n.anchor_id AND NOT n.same
     AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item against all documents."""
    found = ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP12_SQL = r"""
WITH words AS (
    SELECT doc_id, row_number() OVER () AS doc,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), sized AS (
    SELECT doc_id, doc, CAST(len(terms) AS BIGINT) AS n, terms FROM words WHERE len(terms) > 0
), totals AS (
    SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM sized
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), counts AS (
    SELECT doc_id, doc, n, term, count(*) AS tf FROM (SELECT doc_id, doc, n, unnest(terms) AS term FROM sized)
    WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, doc, n, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM counts, totals GROUP BY term, docs
), scored AS (
    SELECT item_id, doc_id, doc, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
    FROM counts JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY item_id, doc_id, doc
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(read(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(
        F.col("id").alias("doc_id"), *counts, "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_topk": op3_exact_topk,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_near_vectors": op6_near_vectors,
    "op7_html": op7_html,
    "op8_sampled_pieces": op8_sampled_pieces,
    "op9_quality": op9_quality,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_lexical": op12_lexical,
    "op13_quality_rules": op13_quality_rules,
    "language_of_pages": language_of_pages,
}

#: The others are held against brute force, round trips and held-out rows in tests/llm.
ORACLES: dict[str, str] = {
    "op3_exact_topk": OP3_SQL,
    "op6_near_vectors": OP6_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_lexical": OP12_SQL,
}
