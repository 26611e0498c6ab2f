"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express them.

The operators here are algorithms over text, html and vectors; where whole-table SQL is possible it is
given in :func:`oracle_sql`, the others are tested against brute force, round trips or held-out cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.llm import encode, knn, main_text, mixing, mojibake, near_dup, residue, sentences, site_lines
from pagestrata.session import stored, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the main body of every page."""
    return main_text.extract_main(table(spark, sf_dir, "html_document")).select("page_id", "block_no").distinct()


def _near_dup_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = near_dup.page_sets(table(spark, sf_dir, "html_document"), least=150, k=3)
    blocks = near_dup.block_sets(table(spark, sf_dir, "text_block"), least=20, k=3)
    return stored(pages.unionAll(blocks), "near-dup-sets")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages and of blocks with three-word shingle similarity of 0.7 or more."""
    return near_dup.near_duplicates(_near_dup_sets(spark, sf_dir), 0.7).select("kind", "id_a", "id_b")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of pages and of blocks linked at five-word shingle similarity of 0.8 or more: one row per record."""
    pages = near_dup.page_sets(table(spark, sf_dir, "html_document"), least=20, k=5)
    blocks = near_dup.block_sets(table(spark, sf_dir, "text_block"), least=20, k=5)
    return near_dup.near_duplicate_groups(stored(pages.unionAll(blocks), "near-dup-sets"), 0.8)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, metas = table(spark, sf_dir, "html_document"), table(spark, sf_dir, "snapshot_meta")
    of_pages = mojibake.visible(pages, "page_id", "html", F.col("wayback_metadata.title")).select(F.lit("html_document").alias("tab"), "rec_id", "text")
    of_metas = metas.select(F.lit("snapshot_meta").alias("tab"), F.col("meta_id").alias("rec_id"), F.col("title").alias("text"))
    return of_pages.unionAll(of_metas)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that hold wrongly decoded text."""
    texts = _texts(spark, sf_dir)
    return mojibake.find_damaged(texts, mojibake.count_frequencies(texts.select("text")))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and captures that hold wrongly decoded text, with their restored text."""
    texts = _texts(spark, sf_dir)
    return mojibake.restore_damaged(texts, mojibake.count_frequencies(texts.select("text")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks whose line returns on ten urls of its site or more."""
    return site_lines.find_site_lines(table(spark, sf_dir, "text_block"), 10)


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the lines of their site."""
    return site_lines.without_site_lines(table(spark, sf_dir, "text_block"), 10)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records at cosine 0.9 or more, one among the five most similar of the other."""
    return knn.similar_pairs(table(spark, sf_dir, "stored_record"), 5, 0.9)


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar records of every record with a sound vector."""
    return knn.most_similar(table(spark, sf_dir, "stored_record"), 5)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with residue in place of content."""
    return residue.find_residue(table(spark, sf_dir, "html_document"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode.encode_texts(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: tokens available, repetitions, target and actual share of the mixture."""
    return mixing.report_mix(mixing.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_target"))


def p9_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their numbers of copies."""
    return mixing.sample_mix(mixing.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_target"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document."""
    return sentences.split_sentences(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return {f.__name__: f for f in (p1_found, p2_found, p2_groups, p3_found, p3_restored, p4_found, p4_cleaned, p5_found, p5_neighbours, p7_found, p8_ids, p9_mix, p9_sample, p10_found)}


_SITE = r"regexp_replace(regexp_replace(lower(trim(coalesce(wayback_domain, regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)', 1)))), '^www\.', ''), ':[0-9]*$', '')"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over the whole tables for the queries that SQL expresses."""
    lines = rf"""
        WITH lines AS (
            SELECT block_id, url, text, position, wayback_timestamp, {_SITE} AS site,
                string_split(trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '0', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words
            FROM text_block WHERE text IS NOT NULL
        ), sound AS (
            SELECT block_id, url, site, array_to_string(words, ' ') AS line FROM lines
            WHERE len(words) >= 3 AND len(list_filter(words, lambda w: regexp_matches(w, '\p{{L}}'))) >= 2
        ), often AS (
            SELECT site, line FROM sound WHERE url IS NOT NULL GROUP BY site, line HAVING count(DISTINCT url) >= 10
        ), hit AS (
            SELECT DISTINCT s.block_id FROM sound s JOIN often o ON s.site IS NOT DISTINCT FROM o.site AND s.line = o.line
        )"""
    return {
        "p4_found": lines + " SELECT block_id FROM hit",
        "p4_cleaned": lines + """, kept AS (
                SELECT DISTINCT block_id, url, wayback_timestamp, coalesce(position, 0) AS position, text FROM lines WHERE block_id NOT IN (SELECT block_id FROM hit)
            )
            SELECT url, wayback_timestamp, (position // 2000)::BIGINT AS segment, CASE WHEN url IS NULL THEN block_id ELSE 0 END AS part,
                string_agg(text, chr(10) ORDER BY position, block_id) AS text, count(*)::INT AS blocks
            FROM kept GROUP BY ALL
        """,
        "p5_found": """
            WITH v AS (
                SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM stored_record
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), pairs AS (
                SELECT a.id, b.id AS other, list_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id
            ), ranked AS (
                SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(c, 9) DESC, other) AS r FROM pairs
            )
            SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM ranked WHERE r <= 5 AND c >= 0.9
        """,
        "p2_found": r"""
            WITH texts AS (
                SELECT DISTINCT 'block' AS kind, block_id AS id, text FROM text_block
                UNION SELECT DISTINCT 'page', page_id, regexp_replace(regexp_replace(regexp_replace(html,
                    '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&#?[a-zA-Z0-9]+;', ' ', 'g') FROM html_document
            ), worded AS (
                SELECT kind, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM texts WHERE text IS NOT NULL
            ), sets AS (
                SELECT kind, id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM worded
            ), fit AS (
                SELECT * FROM sets WHERE len(s) >= CASE kind WHEN 'page' THEN 150 ELSE 20 END
            ), flat AS (
                SELECT kind, id, len(s) AS n, hash(unnest(s)) AS h FROM fit
            ), met AS (
                SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
                FROM flat a JOIN flat b ON a.kind = b.kind AND a.h = b.h AND a.id < b.id GROUP BY 1, 2, 3
            )
            SELECT kind, id_a, id_b FROM met WHERE c >= 0.7 * (na + nb - c) - 1e-9
        """,
    }
