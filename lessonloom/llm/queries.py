"""Queries over the text problems, each over its whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonloom.runtime import materialize, tables

from . import mixing, near_duplicates, packing, reading, scanned, site_lines, splitting
from .tokens import n_tokens


def _text_rows(spark: SparkSession, d: str) -> DataFrame:
    return tables(spark, d)("document_chunks").filter("extraction = 'TEXT'")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(_text_rows(spark, d)).select(F.col("rec").alias("chunk_id"), "line_no").distinct()


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = _text_rows(spark, d)
    return site_lines.without_lines(rows, site_lines.repeated_lines(rows))


def _copy_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    t = tables(spark, d)
    return {
        "document_chunks": t("document_chunks").select(F.col("chunk_id").alias("id"), F.col("normalized_text").alias("text")),
        "lessons": t("lessons").select(F.col("lesson_id").alias("id"), F.col("learning_objective").alias("text")),
    }


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pairs(_copy_tables(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.duplicate_groups(_copy_tables(spark, d))


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(tables(spark, d)("document_chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_pieces(spark, d).filter("piece_no = 1").select("chunk_id")


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = tables(spark, d)
    title = t("source_documents").filter("document_id IS NOT NULL").groupBy(F.col("document_id").alias("doc")).agg(F.max("display_name").alias("title"))
    chunks = t("document_chunks").filter("extraction = 'OCR'").select(F.col("chunk_id").alias("rec"), F.col("document_id").alias("doc"), F.col("page_start").alias("first"), F.col("page_end").alias("last"), F.col("normalized_text").alias("text"))
    pages = t("page_transcriptions").select(F.col("page_id").alias("rec"), F.col("document_id").alias("doc"), F.col("page_number").alias("first"), F.col("page_number").alias("last"), F.col("transcription").alias("text"))
    return chunks.unionByName(pages).join(title, "doc", "left"), t("word_list")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return scanned.noise_lines(*_scanned(spark, d))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    return scanned.repaired_texts(*_scanned(spark, d))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of all documents in tokens, counted once."""
    docs = tables(spark, d)("documents").select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"))
    return materialize(docs.filter("n_tokens > 0").dropDuplicates(["doc_id"]), "tokens")


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_items(_sized(spark, d), tables(spark, d)("container_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, d))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    items = _sized(spark, d)
    plan = mixing.plan(items, tables(spark, d)("mixture_targets"))
    return plan, mixing.draw(items, plan)


def p8_drawn(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, d))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    t = tables(spark, d)
    return reading.reading_levels(t("documents"), t("reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_levels(spark, d).filter("reading_level >= 4").select("doc_id")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    return reading.profile(p9_levels(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_groups, p5_found, p5_pieces, p6_found, p6_text, p7_packed, p7_fill, p8_drawn, p8_shares, p9_found, p9_levels, p9_profile)}

_P1_LINES = """
rows AS (SELECT DISTINCT source_site, document_id, chunk_id, normalized_text FROM document_chunks WHERE extraction = 'TEXT'),
cut AS (SELECT source_site, document_id, chunk_id, unnest(string_split(nfc_normalize(normalized_text), chr(10))) AS line, generate_subscripts(string_split(nfc_normalize(normalized_text), chr(10)), 1) AS line_no FROM rows WHERE normalized_text IS NOT NULL),
keyed AS (SELECT source_site, document_id, chunk_id, line_no, regexp_replace(lower(line), '[^\\p{L}]+', '', 'g') AS k FROM cut WHERE len(regexp_extract_all(line, '\\p{L}+')) >= 3),
total AS (SELECT source_site, count(DISTINCT document_id) AS n FROM rows GROUP BY source_site),
hot AS (SELECT source_site, k, count(DISTINCT document_id) AS n FROM keyed GROUP BY source_site, k),
found AS (SELECT DISTINCT chunk_id, line_no::BIGINT AS line_no FROM keyed JOIN hot USING (source_site, k) JOIN total USING (source_site) WHERE hot.n >= 5 AND hot.n * 50 >= total.n)
"""

SQL = {
    "p1_found": f"WITH {_P1_LINES} SELECT chunk_id, line_no FROM found",
    "p5_found": "SELECT DISTINCT chunk_id FROM document_chunks WHERE length(normalized_text) > 5200",
}
