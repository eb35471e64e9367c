"""Queries over editorial columns, namespaces, edges and counts by class."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonloom.operators import editorial as E
from lessonloom.plans.content import _VIEWS, rows

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {_VIEWS} {sql}"
        return f

    return add


@query(f"SELECT lesson_id, regexp_matches(learning_objective, '(?i){E.action_pattern('($|[^\\p{L}\\p{M}\\p{N}_])')}') AS observable FROM (SELECT DISTINCT lesson_id, learning_objective FROM les)")
def observable_objectives(spark, d):
    """Whether each lesson's objective begins with something a learner does."""
    return rows(spark, d, "lessons", "lesson_id", "learning_objective").select("lesson_id", E.observable(F.col("learning_objective")).alias("observable"))


@query()
def canonical_objectives(spark, d):
    """The objective of each atom in one short form, and whether the lesson's says no more than its title."""
    a = rows(spark, d, "atom_plans", "atom_id", "title", "objective")
    return a.select("atom_id", E.canonical_objective(F.col("objective"), F.col("title")).alias("canonical"), E.is_fallback(F.col("objective"), F.col("title")).alias("fallback"))


@query(r"""SELECT chunk_id, left(trim(coalesce(nullif(list_filter(list_transform(list_reverse(heading_path), lambda h: left(trim(regexp_replace(replace(h, chr(160), ' '), '\s+', ' ', 'g'), ' .-_' || chr(9) || chr(10) || chr(13)), 180)), lambda h: h <> '')[1], ''),
nullif(left(trim(regexp_replace(replace(list_filter(list_transform(string_split(normalized_text, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 4)[1], chr(160), ' '), '\s+', ' ', 'g'), ' .-_' || chr(9) || chr(10) || chr(13)), 180), ''), 'Document') || ' · ' || CASE WHEN page_start = page_end THEN 'trang ' || page_start ELSE 'trang ' || page_start || '–' || page_end END, ' .-_' || chr(9) || chr(10) || chr(13)), 180) AS title
FROM (SELECT DISTINCT chunk_id, heading_path, normalized_text, page_start, page_end FROM ch WHERE NOT regexp_matches(coalesce(normalized_text, ''), '[\x0b-\x0d]'))""")
def unit_titles(spark, d):
    """A title for each chunk: its nearest heading or first line, with its pages."""
    c = rows(spark, d, "document_chunks", "chunk_id", "heading_path", "normalized_text", "page_start", "page_end")
    c = c.filter(~F.coalesce("normalized_text", F.lit("")).rlike(r"[\x0b-\x0d]"))
    return c.select("chunk_id", E.unit_title(F.col("heading_path"), F.col("normalized_text"), F.lit("Document"), F.col("page_start"), F.col("page_end")).alias("title"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])(data\s+files?|code|dataset|dữ\s+liệu)\s+(không\s+|chưa\s+|được\s+)?connected($|[^\p{L}\p{N}_])') THEN 'raw ''connected'' filler' WHEN regexp_matches(t, '(?i)(^|[^\p{L}\p{N}_])initialize\s+problem($|[^\p{L}\p{N}_])') THEN 'raw ''Initialize Problem'' filler' END AS filler
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Dataset chưa connected: ' WHEN 1 THEN 'Initialize Problem. ' ELSE '' END || text AS t FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '(?i)only\s+(model|eval)|dataset\s+v[0-9]+\s+only'))""")
def raw_fillers(spark, d):
    """Untranslated filler in texts, here put before some of them."""
    from lessonloom.runtime import tables

    t = tables(spark, d)("documents").filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"(?i)only\s+(model|eval)|dataset\s+v[0-9]+\s+only"))
    head = F.when(F.col("doc_id") % 5 == 0, "Dataset chưa connected: ").when(F.col("doc_id") % 5 == 1, "Initialize Problem. ").otherwise("")
    return t.select("doc_id", E.raw_filler(F.concat(head, "text")).alias("filler"))


@query("SELECT question_id, coalesce(bloom_level IN ('APPLY', 'ANALYZE', 'UNDERSTAND') AND NOT (bloom_level = 'APPLY' AND contains(lower(stem), 'gradient')), false) AS allowed FROM (SELECT DISTINCT question_id, bloom_level, stem FROM qs)")
def allowed_questions(spark, d):
    """An allow-list of levels, one of which a word in the stem vetoes."""
    q = rows(spark, d, "questions", "question_id", "bloom_level", "stem")
    return q.select("question_id", E.allowed(F.col("bloom_level"), ["APPLY", "ANALYZE", "UNDERSTAND"], F.coalesce("stem", F.lit("")), {"APPLY": "gradient"}).alias("allowed"))


@query("SELECT mime_type, count(DISTINCT sha256) AS assets, count(*) AS occurrences, sum(coalesce(byte_size, 0))::BIGINT AS bytes FROM (SELECT DISTINCT illustration_id, sha256, mime_type, byte_size FROM ills) GROUP BY mime_type")
def media_class_counts(spark, d):
    """Different pictures and their occurrences by class."""
    i = rows(spark, d, "illustration_assets", "illustration_id", "sha256", "mime_type", "byte_size")
    return i.groupBy("mime_type").agg(F.count_distinct("sha256").alias("assets"), F.count(F.lit(1)).alias("occurrences"), F.sum(F.coalesce("byte_size", F.lit(0))).cast("long").alias("bytes"))


@query("SELECT spaces, count(*) AS ids FROM (SELECT right(id, 4) AS stem, count(DISTINCT ns) AS spaces FROM (SELECT 'atom' AS ns, atom_id AS id FROM atoms UNION SELECT 'lesson', lesson_id FROM les UNION SELECT 'pair', pair_id FROM pairs UNION SELECT 'question', question_id FROM qs) WHERE id IS NOT NULL GROUP BY stem) GROUP BY spaces")
def shared_names(spark, d):
    """In how many namespaces the last four signs of ids are used: one each would make them unique across all."""
    ids = None
    for ns, table, col in (("atom", "atom_plans", "atom_id"), ("lesson", "lessons", "lesson_id"), ("pair", "learning_pairs", "pair_id"), ("question", "questions", "question_id")):
        one = rows(spark, d, table, col).select(F.lit(ns).alias("ns"), F.col(col).alias("id"))
        ids = one if ids is None else ids.unionByName(one)
    stems = ids.filter("id IS NOT NULL").groupBy(F.right("id", F.lit(4)).alias("stem")).agg(F.count_distinct("ns").alias("spaces"))
    return stems.groupBy("spaces").agg(F.count(F.lit(1)).alias("ids"))


_EDGES = "SELECT DISTINCT atom_id AS v, unnest(prerequisite_ids) AS p FROM"


@query(f"SELECT CASE WHEN a.v IS NULL THEN 'lesson' WHEN b.v IS NULL THEN 'plan' ELSE 'both' END AS declared_by, count(*) AS edges FROM (SELECT * FROM ({_EDGES} atom_plans) WHERE v IS NOT NULL AND p IS NOT NULL) a FULL JOIN (SELECT * FROM ({_EDGES} lessons) WHERE v IS NOT NULL AND p IS NOT NULL) b ON a.v = b.v AND a.p = b.p GROUP BY ALL")
def edge_conformance(spark, d):
    """Prerequisite edges by who declares them: the sets agree if all are in both."""
    e = lambda t, s: rows(spark, d, t, "atom_id", "prerequisite_ids").select(F.col("atom_id").alias("v"), F.explode("prerequisite_ids").alias("p")).filter("v IS NOT NULL AND p IS NOT NULL").distinct().withColumn(s, F.lit(True))
    j = e("atom_plans", "a").join(e("lessons", "b"), ["v", "p"], "full_outer")
    return j.groupBy(F.when(F.col("a").isNull(), "lesson").when(F.col("b").isNull(), "plan").otherwise("both").alias("declared_by")).agg(F.count(F.lit(1)).alias("edges"))
