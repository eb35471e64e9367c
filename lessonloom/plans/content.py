"""Queries over documents, chunks, lessons, questions and their joins, sets, numbers and texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lessonloom.functions.hashing import digest, stable_id
from lessonloom.functions.text import normalize_text, nullif_blank, search_fold, words
from lessonloom.operators import content as C
from lessonloom.operators import partitioning as P
from lessonloom.operators import study as S
from lessonloom.runtime import tables

QUERIES: dict = {}
SQL: dict = {}

#: Rows without their redeliveries: everything but the time of arrival is the same in those.
_VIEWS = """
docs AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM source_documents),
ch AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM document_chunks),
atoms AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM atom_plans),
les AS (SELECT DISTINCT lesson_id, pair_id, atom_id, title, learning_objective, source_ref_ids, estimated_seconds, takeaways, hook, intuition FROM lessons),
pairs AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM learning_pairs),
qs AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM questions),
ills AS (SELECT DISTINCT * EXCLUDE (ingested_at) FROM illustration_assets)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {_VIEWS}{',' if sql.startswith('w AS') else ''} {sql}"
        return f

    return add


def rows(spark, d, name, *columns):
    """A table without redeliveries, cut to the columns asked for before anything is shuffled."""
    df = tables(spark, d)(name)
    return (df.select(*columns) if columns else df.drop("ingested_at")).distinct()


# --- text and identity -----------------------------------------------------------------------------------------


@query(r"SELECT chunk_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(normalized_text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160))) AS h FROM ch WHERE normalized_text IS NOT NULL")
def text_normalize(spark, d):
    c = tables(spark, d)("document_chunks").filter("normalized_text IS NOT NULL")
    return c.select("chunk_id", F.sha2(normalize_text(F.col("normalized_text")).cast("binary"), 256).alias("h")).distinct()


@query("SELECT chunk_id, 'sha256:' || sha256(normalized_text) AS content_hash, text_hash IS DISTINCT FROM 'sha256:' || sha256(normalized_text) AS stale FROM ch WHERE normalized_text IS NOT NULL")
def content_hash(spark, d):
    c = tables(spark, d)("document_chunks").filter("normalized_text IS NOT NULL")
    h = digest(F.col("normalized_text"))
    return c.select("chunk_id", h.alias("content_hash"), (~F.col("text_hash").eqNullSafe(h)).alias("stale")).distinct()


@query("SELECT chunk_id, 'chunk_' || left(sha256(document_id || chr(31) || page_start || chr(31) || text_hash), 16) AS made_id FROM ch")
def stable_ids(spark, d):
    return rows(spark, d, "document_chunks", "chunk_id", stable_id("chunk", F.col("document_id"), F.col("page_start"), F.col("text_hash")).alias("made_id"))


@query(r"SELECT document_id, left(regexp_replace(regexp_extract(logical_path, '([^/\\]*)$', 1), '[^A-Za-z0-9._-]+', '_', 'g'), 120) AS safe FROM docs")
def safe_filename(spark, d):
    return rows(spark, d, "source_documents", "document_id", C.safe_filename(F.col("logical_path")).alias("safe"))


@query(r"SELECT document_id, trim(regexp_replace(coalesce(display_name, filename), '(?i)\.(?:pdf|pptx|docx|md|markdown|txt)$', '')) AS shown FROM docs")
def display_name(spark, d):
    return rows(spark, d, "source_documents", "document_id", C.display_name(F.coalesce("display_name", "filename")).alias("shown"))


@query(r"SELECT doc_id, coalesce(nullif(trim(left(trim(regexp_replace(title, '\s+', ' ', 'g'), ' .-_' || chr(9) || chr(10) || chr(13)), 180), ' .-_' || chr(9) || chr(10) || chr(13)), ''), 'doc ' || doc_id) AS clean FROM documents")
def clean_title(spark, d):
    return tables(spark, d)("documents").select("doc_id", C.clean_title(F.col("title"), F.concat(F.lit("doc "), "doc_id")).alias("clean"))


@query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE rtrim(left(text, 499)) || '…' END AS short FROM documents")
def bounded_text(spark, d):
    return tables(spark, d)("documents").select("doc_id", C.bounded(F.col("text")).alias("short"))


@query(r"SELECT lesson_id, trim(regexp_replace(replace(strip_accents(lower(title)), 'đ', 'd'), '\s+', ' ', 'g')) AS folded FROM les")
def search_folded(spark, d):
    return rows(spark, d, "lessons", "lesson_id", "title").select("lesson_id", search_fold(F.col("title")).alias("folded"))


@query("SELECT lesson_id, title FROM les WHERE contains(replace(strip_accents(lower(concat_ws(chr(10), title, learning_objective, hook, intuition, array_to_string(takeaways, chr(10))))), 'đ', 'd'), 'bo nho')")
def lesson_search(spark, d):
    return C.search(rows(spark, d, "lessons", "lesson_id", "title", "learning_objective", "hook", "intuition", "takeaways"), ["title", "learning_objective", "hook", "intuition", "takeaways"], "Bộ  nhớ").select("lesson_id", "title")


_KINDS = [("(?iu)bài giảng|lecture|slide", "LECTURE"), ("(?iu)forum", "FORUM"), ("(?iu)wiki|ghichu", "NOTES")]


@query("SELECT doc_id, CASE WHEN regexp_matches(source, '(?i)bài giảng|lecture|slide') THEN 'LECTURE' WHEN regexp_matches(source, '(?i)forum') THEN 'FORUM' WHEN regexp_matches(source, '(?i)wiki|ghichu') THEN 'NOTES' ELSE 'OTHER' END AS category FROM documents")
def category_rules(spark, d):
    return tables(spark, d)("documents").select("doc_id", C.by_rules(F.col("source"), _KINDS, "OTHER").alias("category"))


@query("SELECT lesson_id, list_filter([CASE WHEN regexp_matches(lower(title), 'gradient|tốc độ học|learning rate') THEN 'training' END, CASE WHEN regexp_matches(lower(title), 'bộ nhớ|cache|memory') THEN 'memory' END, CASE WHEN regexp_matches(lower(title), 'attention|chú ý') THEN 'attention' END], lambda x: x IS NOT NULL) AS tags FROM les WHERE title IS NOT NULL")
def search_tags(spark, d):
    needles = {"training": ("gradient", "tốc độ học", "learning rate"), "memory": ("bộ nhớ", "cache", "memory"), "attention": ("attention", "chú ý")}
    return rows(spark, d, "lessons", "lesson_id", "title").filter("title IS NOT NULL").select("lesson_id", C.tags(F.col("title"), needles).alias("tags"))


@query(r"SELECT document_id, mime_type, CASE lower(regexp_extract(filename, '\.([A-Za-z0-9]+)$', 1)) WHEN 'pdf' THEN 'application/pdf' WHEN 'pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation' WHEN 'docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 'md' THEN 'text/markdown' WHEN 'markdown' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS by_suffix FROM docs WHERE filename IS NOT NULL")
def media_types(spark, d):
    return rows(spark, d, "source_documents", "document_id", "mime_type", "filename").filter("filename IS NOT NULL").select("document_id", "mime_type", C.mime_of(F.col("filename")).alias("by_suffix"))


@query("SELECT document_id, list_has_any(string_split(replace(source_path, '\\', '/'), '/'), ['', '.', '..']) OR starts_with(source_path, '/') OR regexp_matches(source_path, '^[A-Za-z]:') AS unsafe FROM docs WHERE source_path IS NOT NULL")
def unsafe_paths(spark, d):
    return rows(spark, d, "source_documents", "document_id", "source_path").filter("source_path IS NOT NULL").select("document_id", C.unsafe_path(F.col("source_path")).alias("unsafe"))


@query(r"SELECT document_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, CASE WHEN contains(url, 'forum') THEN 'FORUM' WHEN url LIKE '%.pdf' THEN 'PDF' ELSE 'PAGE' END AS kind FROM (SELECT document_id, 'https://' || source_site || '.example/' || coalesce(filename, '') AS url FROM docs WHERE source_site IS NOT NULL)")
def link_classes(spark, d):
    url = F.concat(F.lit("https://"), "source_site", F.lit(".example/"), F.coalesce("filename", F.lit("")))
    r = rows(spark, d, "source_documents", "document_id", "source_site", "filename").filter("source_site IS NOT NULL").select("document_id", url.alias("url"))
    return r.select("document_id", F.try_parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.try_parse_url("url", F.lit("HOST")).alias("host"), F.when(F.col("url").contains("forum"), "FORUM").when(F.col("url").endswith(".pdf"), "PDF").otherwise("PAGE").alias("kind"))


_ARTIFACTS = [(r"(?i)(?:source|nguồn)\s*:", "source line"), (r"(?i)https?://|www\.", "address"), (r"(?i)\.(?:pdf|pptx?|docx?)\b", "file name"), (r"(?i)agenda|mục lục", "agenda"), (r"(?i)\b(?:trang|slide|page)\s*\d+", "page label")]


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(?:source|nguồn)\s*:') THEN 'source line' WHEN regexp_matches(text, '(?i)https?://|www\.') THEN 'address' WHEN regexp_matches(text, '(?i)\.(?:pdf|pptx?|docx?)\b') THEN 'file name' WHEN regexp_matches(text, '(?i)agenda|mục lục') THEN 'agenda' WHEN regexp_matches(text, '(?i)\b(?:trang|slide|page)\s*\d+') THEN 'page label' ELSE 'clean' END AS artifact FROM documents WHERE text IS NOT NULL")
def artifact_labels(spark, d):
    return tables(spark, d)("documents").filter("text IS NOT NULL").select("doc_id", C.by_rules(F.col("text"), _ARTIFACTS, "clean").alias("artifact"))


@query(r"SELECT lesson_id, length(title) BETWEEN 4 AND 180 AND NOT regexp_matches(title, '(?i)\b(?:trang|page|part|phần)\s*\d+') AS title_ok, len(regexp_extract_all(title, '[\p{L}\p{N}_]+')) BETWEEN 2 AND 14 AS words_ok FROM les WHERE title IS NOT NULL")
def title_rules(spark, d):
    t = F.col("title")
    return rows(spark, d, "lessons", "lesson_id", "title").filter("title IS NOT NULL").select("lesson_id", (F.length(t).between(4, 180) & ~t.rlike(r"(?iU)\b(?:trang|page|part|phần)\s*\d+")).alias("title_ok"), F.size(words(t)).between(2, 14).alias("words_ok"))


@query(r"SELECT lesson_id, len(list_concat(regexp_extract_all(coalesce(hook, ''), '[\p{L}\p{N}_]+'), regexp_extract_all(coalesce(intuition, ''), '[\p{L}\p{N}_]+'))) AS prose_words, len(takeaways) AS n_takeaways FROM les")
def word_counts(spark, d):
    n = lambda c: F.size(words(F.coalesce(c, F.lit(""))))
    return rows(spark, d, "lessons", "lesson_id", "hook", "intuition", "takeaways").select("lesson_id", (n("hook") + n("intuition")).alias("prose_words"), F.when(F.col("takeaways").isNotNull(), F.size("takeaways")).alias("n_takeaways"))


@query("SELECT chunk_id, array_to_string(list_filter(heading_path, lambda h: trim(h) <> ''), ' › ') AS trail FROM ch WHERE heading_path IS NOT NULL")
def heading_trail(spark, d):
    return rows(spark, d, "document_chunks", "chunk_id", "heading_path").filter("heading_path IS NOT NULL").select("chunk_id", F.array_join(F.filter("heading_path", lambda h: F.trim(h) != ""), " › ").alias("trail"))


@query("SELECT illustration_id, coalesce(nullif(trim(alt_text), ''), nullif(trim(caption), ''), asset_member) AS alt FROM ills")
def alt_fallback(spark, d):
    return rows(spark, d, "illustration_assets", "illustration_id", "alt_text", "caption", "asset_member").select("illustration_id", F.coalesce(nullif_blank(F.trim("alt_text")), nullif_blank(F.trim("caption")), F.col("asset_member")).alias("alt"))


# --- duplicates and sets ---------------------------------------------------------------------------------------


@query("SELECT sha256, count(DISTINCT document_id) AS copies, min(document_id) AS canonical FROM source_documents WHERE sha256 IS NOT NULL GROUP BY sha256")
def exact_dedupe(spark, d):
    return C.exact_duplicates(tables(spark, d)("source_documents").select("sha256", "document_id"), "sha256", "document_id")


@query("SELECT hash AS text_key, count(DISTINCT doc_id) AS copies, min(doc_id) AS canonical FROM (SELECT sha256(text) AS hash, doc_id FROM documents WHERE text IS NOT NULL) GROUP BY hash HAVING count(DISTINCT doc_id) > 1")
def text_dedupe(spark, d):
    t = tables(spark, d)("documents").filter("text IS NOT NULL").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_key"), "doc_id")
    return C.exact_duplicates(t, "text_key", "doc_id").filter("copies > 1")


@query("SELECT DISTINCT d.document_id, c.canonical FROM source_documents d JOIN (SELECT sha256, min(document_id) AS canonical FROM source_documents WHERE sha256 IS NOT NULL GROUP BY sha256) c USING (sha256)")
def document_aliases(spark, d):
    return C.aliases(tables(spark, d)("source_documents").select("sha256", "document_id"), "sha256", "document_id")


@query("SELECT mime_type, count(DISTINCT sha256) AS assets, count(DISTINCT illustration_id) AS occurrences, sum(byte_size) AS bytes FROM ills GROUP BY mime_type")
def media_counts(spark, d):
    return rows(spark, d, "illustration_assets").groupBy("mime_type").agg(F.count_distinct("sha256").alias("assets"), F.count_distinct("illustration_id").alias("occurrences"), F.sum("byte_size").alias("bytes"))


@query("SELECT source_format, count(DISTINCT coalesce(mime_type, '')) AS variants FROM source_documents WHERE source_format IS NOT NULL GROUP BY source_format HAVING variants > 1")
def dedupe_conflict(spark, d):
    """Formats that stand under several media types."""
    t = tables(spark, d)("source_documents").filter("source_format IS NOT NULL").select("source_format", F.coalesce("mime_type", F.lit("")).alias("m"))
    return C.conflicts(t, "source_format", ["m"])


@query("SELECT chunk_id, count(*) AS deliveries, count(DISTINCT normalized_text) AS texts FROM document_chunks GROUP BY chunk_id HAVING count(*) > 1")
def chunk_redeliveries(spark, d):
    t = tables(spark, d)("document_chunks").select("chunk_id", F.when(F.col("normalized_text").isNotNull(), F.xxhash64("normalized_text")).alias("h"))
    return t.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("deliveries"), F.count_distinct("h").alias("texts")).filter("deliveries > 1")


@query(r"""SELECT x.atom_id, x.question_id AS a, y.question_id AS b, len(list_intersect(x.w, y.w)) / greatest(1, len(list_distinct(list_concat(x.w, y.w)))) AS score FROM
(SELECT atom_id, question_id, list_distinct(regexp_extract_all(lower(stem), '[\p{L}\p{N}_]+')) AS w FROM qs WHERE stem IS NOT NULL) x JOIN (SELECT atom_id, question_id, list_distinct(regexp_extract_all(lower(stem), '[\p{L}\p{N}_]+')) AS w FROM qs WHERE stem IS NOT NULL) y
ON x.atom_id = y.atom_id AND x.question_id < y.question_id WHERE len(list_intersect(x.w, y.w)) / greatest(1, len(list_distinct(list_concat(x.w, y.w)))) > 0.5""")
def near_dup_stems(spark, d):
    q = rows(spark, d, "questions", "atom_id", "question_id", "stem").filter("stem IS NOT NULL").select("atom_id", "question_id", F.array_distinct(words(F.lower("stem"))).alias("w"))
    return C.similar_in_group(q, "atom_id", "question_id", "w", 0.5)


@query(r"""SELECT kind, course_id, trim(regexp_replace(lower(x), '\s+', ' ', 'g')) AS text_key, count(*) AS n FROM (SELECT 'title' AS kind, atom_id, course_id, title AS x FROM atoms UNION ALL
SELECT DISTINCT 'objective', atom_id, course_id, learning_objective FROM les JOIN (SELECT DISTINCT atom_id, course_id FROM atoms) USING (atom_id)) WHERE trim(x) <> '' GROUP BY ALL HAVING count(*) > 1""")
def repeated_titles(spark, d):
    """Titles and objectives that several atoms of a course share, aside from case and spacing."""
    a = rows(spark, d, "atom_plans", "atom_id", "course_id", "title")
    o = rows(spark, d, "lessons", "atom_id", "learning_objective").join(a.select("atom_id", "course_id").distinct(), "atom_id")
    both = a.select(F.lit("title").alias("kind"), "course_id", F.col("title").alias("x")).unionByName(o.select(F.lit("objective").alias("kind"), "course_id", F.col("learning_objective").alias("x")))
    key = F.trim(F.regexp_replace(F.lower("x"), r"\s+", " "))
    return both.filter("trim(x) <> ''").groupBy("kind", "course_id", key.alias("text_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT question_id, len(options) AS n_options, len(list_distinct(list_transform(options, lambda o: lower(trim(o.text))))) AS n_different, list_contains(list_transform(options, lambda o: o.id), correct_option_id) AS has_right FROM qs")
def option_checks(spark, d):
    q = rows(spark, d, "questions", "question_id", "options", "correct_option_id")
    return q.select("question_id", F.size("options").alias("n_options"), F.size(F.array_distinct(F.transform("options", lambda o: F.lower(F.trim(o["text"]))))).alias("n_different"), F.array_contains(F.transform("options", lambda o: o["id"]), F.col("correct_option_id")).alias("has_right"))


@query("SELECT CASE WHEN o.document_id IS NULL THEN 'chunks' WHEN c.document_id IS NULL THEN 'documents' ELSE 'both' END AS named_in, count(*) AS documents FROM (SELECT DISTINCT source_ref.document_id AS document_id FROM document_chunks WHERE source_ref.document_id IS NOT NULL) c FULL JOIN (SELECT DISTINCT document_id FROM source_documents WHERE document_id IS NOT NULL) o USING (document_id) GROUP BY ALL")
def document_set_difference(spark, d):
    """Documents that only chunks name, that no chunk names, and that both do."""
    t = tables(spark, d)
    c = t("document_chunks").select("source_ref.document_id").filter("document_id IS NOT NULL").distinct().withColumn("c", F.lit(True))
    o = t("source_documents").select("document_id").filter("document_id IS NOT NULL").distinct().withColumn("o", F.lit(True))
    side = F.when(F.col("o").isNull(), "chunks").when(F.col("c").isNull(), "documents").otherwise("both")
    return c.join(o, "document_id", "full_outer").groupBy(side.alias("named_in")).agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT side, count(*) AS n FROM (SELECT 'atoms_only' AS side FROM (SELECT atom_id FROM atoms EXCEPT SELECT atom_id FROM les) UNION ALL SELECT 'lessons_only' FROM (SELECT atom_id FROM les EXCEPT SELECT atom_id FROM atoms) UNION ALL SELECT 'both' FROM (SELECT atom_id FROM les INTERSECT SELECT atom_id FROM atoms)) GROUP BY side")
def set_differences(spark, d):
    t = tables(spark, d)
    a, b = t("atom_plans").select("atom_id"), t("lessons").select("atom_id")
    side = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("side"), "n").filter("n > 0")
    return side(a.subtract(b), "atoms_only").unionByName(side(b.subtract(a), "lessons_only")).unionByName(side(a.intersect(b), "both"))


@query("SELECT l.lesson_id, len(list_filter(l.source_ref_ids, lambda x: NOT coalesce(list_contains(a.source_ref_ids, x), false))) AS outside, l.source_ref_ids = a.source_ref_ids AS same_order FROM les l JOIN atoms a USING (atom_id) WHERE l.source_ref_ids IS NOT NULL AND a.source_ref_ids IS NOT NULL")
def subset_checks(spark, d):
    a = rows(spark, d, "atom_plans", "atom_id", F.col("source_ref_ids").alias("planned")).filter("planned IS NOT NULL")
    lessons = rows(spark, d, "lessons", "lesson_id", "atom_id", "source_ref_ids").filter("source_ref_ids IS NOT NULL")
    missing = F.filter("source_ref_ids", lambda x: ~F.coalesce(F.array_contains(F.col("planned"), x), F.lit(False)))
    return lessons.join(a, "atom_id").select("lesson_id", F.size(missing).alias("outside"), (F.col("source_ref_ids") == F.col("planned")).alias("same_order"))


@query("SELECT r AS source_ref_id, count(*) AS uses FROM (SELECT unnest(source_ref_ids) AS r FROM atoms) GROUP BY r HAVING count(*) <> 1")
def multiset_uses(spark, d):
    return rows(spark, d, "atom_plans", "atom_id", "source_ref_ids").select(F.explode("source_ref_ids").alias("source_ref_id")).groupBy("source_ref_id").agg(F.count(F.lit(1)).alias("uses")).filter("uses <> 1")


# --- joins -----------------------------------------------------------------------------------------------------


@query("SELECT q.question_id, p.pair_id, p.atom_id, pos::BIGINT AS pos FROM (SELECT pair_id, atom_id, unnest(question_ids) AS question_id, generate_subscripts(question_ids, 1) - 1 AS pos FROM pairs) p JOIN qs q USING (question_id)")
def question_index(spark, d):
    p = rows(spark, d, "learning_pairs", "pair_id", "atom_id", "question_ids").select("pair_id", "atom_id", F.posexplode("question_ids").alias("pos", "question_id"))
    return p.join(rows(spark, d, "questions", "question_id"), "question_id").select("question_id", "pair_id", "atom_id", F.col("pos").cast("long").alias("pos"))


@query("SELECT a.course_id, a.module_id, a.atom_id, l.lesson_id, p.pair_id, len(p.question_ids) AS n_questions FROM atoms a JOIN les l USING (atom_id) JOIN pairs p ON p.micro_lesson_id = l.lesson_id")
def catalog_rows(spark, d):
    a = rows(spark, d, "atom_plans", "course_id", "module_id", "atom_id")
    lessons = rows(spark, d, "lessons", "lesson_id", "atom_id")
    p = rows(spark, d, "learning_pairs", "pair_id", F.col("micro_lesson_id").alias("lesson_id"), F.size("question_ids").alias("n_questions"))
    return a.join(lessons, "atom_id").join(p, "lesson_id").select("course_id", "module_id", "atom_id", "lesson_id", "pair_id", "n_questions")


@query("SELECT i.illustration_id, c.chunk_id, i.page_number BETWEEN c.source_ref.page_start AND c.source_ref.page_end AS inside FROM ills i JOIN ch c ON c.source_ref.source_ref_id = i.source_ref_id")
def page_inside_range(spark, d):
    c = rows(spark, d, "document_chunks", "chunk_id", F.col("source_ref.source_ref_id").alias("source_ref_id"), F.col("source_ref.page_start").alias("lo"), F.col("source_ref.page_end").alias("hi"))
    i = rows(spark, d, "illustration_assets", "illustration_id", "source_ref_id", "page_number")
    return i.join(c, "source_ref_id").select("illustration_id", "chunk_id", F.col("page_number").between(F.col("lo"), F.col("hi")).alias("inside"))


@query("SELECT a.atom_id, bool_and(coalesce(m.ok, false)) FILTER (p IS NOT NULL) IS NOT FALSE AS eligible FROM (SELECT atom_id, unnest(CASE WHEN prerequisite_ids IS NULL OR len(prerequisite_ids) = 0 THEN [NULL] ELSE prerequisite_ids END) AS p FROM atoms) a LEFT JOIN (SELECT DISTINCT atom_id AS k, true AS ok FROM les WHERE estimated_seconds >= 45) m ON m.k = a.p GROUP BY a.atom_id")
def prereq_eligible(spark, d):
    a = rows(spark, d, "atom_plans", "atom_id", "prerequisite_ids")
    done = tables(spark, d)("lessons").filter("estimated_seconds >= 45").select("atom_id").distinct()
    return S.eligible(a, done)


@query("""SELECT coalesce(a.k, b.k) AS collection, a.n AS atoms, b.n AS lessons FROM (SELECT module_id AS k, count(*) AS n FROM atoms GROUP BY 1) a FULL JOIN (SELECT a.module_id AS k, count(*) AS n FROM les l JOIN atoms a USING (atom_id) WHERE l.estimated_seconds > 60 GROUP BY 1) b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""")
def count_mismatch(spark, d):
    a = rows(spark, d, "atom_plans", "atom_id", "module_id")
    n = F.count(F.lit(1))
    x = a.groupBy(F.col("module_id").alias("collection")).agg(n.alias("atoms"))
    y = rows(spark, d, "lessons", "lesson_id", "atom_id", "estimated_seconds").filter("estimated_seconds > 60").join(a, "atom_id").groupBy(F.col("module_id").alias("collection")).agg(n.alias("lessons"))
    return x.join(y, "collection", "full_outer").filter(~F.col("atoms").eqNullSafe(F.col("lessons")))


@query("SELECT c.chunk_id, coalesce(d.display_name, d.filename) AS label, row_number() OVER (PARTITION BY c.document_id ORDER BY c.page_start, c.page_end, c.chunk_id) AS segment, count(*) OVER (PARTITION BY c.document_id) AS segments FROM ch c JOIN docs d USING (document_id)")
def excerpt_segments(spark, d):
    c = rows(spark, d, "document_chunks", "chunk_id", "document_id", "page_start", "page_end")
    t = rows(spark, d, "source_documents", "document_id", F.coalesce("display_name", "filename").alias("label"))
    n = c.groupBy("document_id").agg(F.count(F.lit(1)).alias("segments"))
    out = C.group_number(c, ["document_id"], ["page_start", "page_end", "chunk_id"], "segment").withColumn("segment", F.col("segment") + 1)
    return out.join(n, "document_id").join(t, "document_id").select("chunk_id", "label", "segment", "segments")


@query("SELECT item_id, pair_id FROM (SELECT lesson_id AS item_id, pair_id FROM les UNION ALL SELECT question_id, pair_id FROM qs UNION ALL SELECT pair_id, pair_id FROM pairs) WHERE pair_id IN (SELECT pair_id FROM pairs)")
def item_routing(spark, d):
    pairs = rows(spark, d, "learning_pairs", "pair_id")
    items = rows(spark, d, "lessons", F.col("lesson_id").alias("item_id"), "pair_id").unionByName(rows(spark, d, "questions", F.col("question_id").alias("item_id"), "pair_id")).unionByName(pairs.select(F.col("pair_id").alias("item_id"), "pair_id"))
    return items.join(pairs, "pair_id", "left_semi").select("item_id", "pair_id")


@query("SELECT l.lesson_id, coalesce(CASE WHEN l.estimated_seconds > 80 THEN 'revised: ' || l.title END, l.title) AS title FROM les l")
def overlay_update(spark, d):
    """Rows replaced by key, the others kept."""
    old = rows(spark, d, "lessons", "lesson_id", "title", "estimated_seconds")
    new = old.filter("estimated_seconds > 80").select("lesson_id", F.concat(F.lit("revised: "), "title").alias("new_title"))
    return old.join(new, "lesson_id", "left").select("lesson_id", F.coalesce("new_title", "title").alias("title"))


@query("SELECT document_id, page_start AS page, arg_max(chunk_id, (coalesce(length(normalized_text), 0), chunk_id)) AS longest FROM ch GROUP BY ALL")
def longest_chunk(spark, d):
    c = tables(spark, d)("document_chunks").select("document_id", F.col("page_start").alias("page"), "chunk_id", F.coalesce(F.length("normalized_text"), F.lit(0)).alias("n"))
    return c.groupBy("document_id", "page").agg(F.max(F.struct("n", "chunk_id")).alias("b")).select("document_id", "page", F.col("b.chunk_id").alias("longest"))


@query("SELECT pair_id, list_filter(question_ids, lambda x: coalesce(NOT list_contains(r.done, x), true))[1] AS next_question FROM pairs LEFT JOIN (SELECT pair_id, list(DISTINCT question_id) AS done FROM qs WHERE difficulty <= 2 GROUP BY pair_id) r USING (pair_id)")
def first_unanswered(spark, d):
    p = rows(spark, d, "learning_pairs", "pair_id", "question_ids")
    done = rows(spark, d, "questions", "pair_id", "question_id", "difficulty").filter("difficulty <= 2").groupBy("pair_id").agg(F.collect_set("question_id").alias("done"))
    rest = F.filter("question_ids", lambda x: F.coalesce(~F.array_contains(F.col("done"), x), F.lit(True)))
    return p.join(done, "pair_id", "left").select("pair_id", F.get(rest, F.lit(0)).alias("next_question"))


# --- aggregates ------------------------------------------------------------------------------------------------


@query("SELECT document_id, page_start AS page, sum(coalesce(length(normalized_text), 0))::BIGINT AS chars, count(*) AS chunks FROM ch GROUP BY ALL")
def text_per_page(spark, d):
    c = rows(spark, d, "document_chunks", "chunk_id", "document_id", F.col("page_start").alias("page"), F.coalesce(F.length("normalized_text"), F.lit(0)).alias("n"))
    return c.groupBy("document_id", "page").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("chunks"))


@query("SELECT document_id, avg(n) AS mean_chars, avg((n < 10)::INT) AS empty_share, avg(n) < 40 OR avg((n < 10)::INT) > 0.6 AS needs_ocr FROM (SELECT document_id, page_start, sum(coalesce(length(trim(normalized_text)), 0)) AS n FROM ch GROUP BY ALL) GROUP BY document_id")
def text_layer_gate(spark, d):
    pages = rows(spark, d, "document_chunks", "chunk_id", "document_id", "page_start", F.coalesce(F.length(F.trim("normalized_text")), F.lit(0)).alias("c")).groupBy("document_id", "page_start").agg(F.sum("c").alias("n"))
    g = pages.groupBy("document_id").agg(F.avg("n").alias("mean_chars"), F.avg((F.col("n") < 10).cast("int")).alias("empty_share"))
    return g.withColumn("needs_ocr", (F.col("mean_chars") < 40) | (F.col("empty_share") > 0.6))


@query("SELECT source_format, count(*) AS occurrences, count(DISTINCT sha256) AS documents, count(*) - count(DISTINCT sha256) AS duplicates, sum(greatest(1, len(source_aliases)))::BIGINT AS paths FROM docs GROUP BY source_format")
def inventory_counts(spark, d):
    g = rows(spark, d, "source_documents", "document_id", "sha256", "source_format", "source_aliases").groupBy("source_format")
    n, u = F.count(F.lit(1)), F.count_distinct("sha256")
    return g.agg(n.alias("occurrences"), u.alias("documents"), (n - u).alias("duplicates"), F.sum(F.when(F.col("source_aliases").isNotNull(), F.greatest(F.lit(1), F.size("source_aliases")))).alias("paths"))


@query("SELECT module_id, count(*) AS lessons, greatest(5, round_even(sum(estimated_seconds) / 60, 0))::BIGINT AS minutes FROM les JOIN atoms USING (atom_id) GROUP BY module_id")
def module_minutes(spark, d):
    j = rows(spark, d, "lessons", "lesson_id", "atom_id", "estimated_seconds").join(rows(spark, d, "atom_plans", "atom_id", "module_id"), "atom_id")
    return j.groupBy("module_id").agg(F.count(F.lit(1)).alias("lessons"), F.greatest(F.lit(5), F.bround(F.sum("estimated_seconds") / 60)).cast("long").alias("minutes"))


@query("SELECT coalesce(ai_review_status, 'NONE') AS status, count(*) AS pairs, array_to_string(list_sort(list(DISTINCT revision::VARCHAR)), ',') AS revisions FROM pairs GROUP BY 1")
def status_counts(spark, d):
    p = rows(spark, d, "learning_pairs", "pair_id", F.coalesce("ai_review_status", F.lit("NONE")).alias("status"), "revision")
    return p.groupBy("status").agg(F.count(F.lit(1)).alias("pairs"), F.array_join(F.array_sort(F.collect_set(F.col("revision").cast("string"))), ",").alias("revisions"))


@query("SELECT document_id, string_agg(n || '. ' || caption, chr(10) || chr(10) ORDER BY page_number, page_id) AS captions FROM (SELECT DISTINCT document_id, page_number, page_id, trim(caption) AS caption, row_number() OVER (PARTITION BY document_id ORDER BY page_number, page_id) AS n FROM (SELECT DISTINCT document_id, page_number, page_id, caption FROM page_transcriptions WHERE trim(caption) <> '')) GROUP BY document_id")
def caption_lists(spark, d):
    p = rows(spark, d, "page_transcriptions", "document_id", "page_number", "page_id", F.trim("caption").alias("caption")).filter("caption <> ''")
    s = p.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "caption"))).alias("s"))
    return s.select("document_id", F.array_join(F.transform("s", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["caption"])), "\n\n").alias("captions"))


@query("SELECT bloom_level, difficulty, count(*) AS n FROM qs GROUP BY GROUPING SETS ((bloom_level, difficulty), (bloom_level), ())")
def question_rollup(spark, d):
    q = rows(spark, d, "questions", "question_id", "bloom_level", "difficulty")
    return q.rollup("bloom_level", "difficulty").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT document_id, list_filter([CASE WHEN n = 0 THEN 'IMAGE_ONLY' END, CASE WHEN n > 0 AND n < 40 THEN 'LOW_TEXT' END, CASE WHEN caption IS NULL OR trim(caption) = '' THEN 'MISSING_ALT' END], lambda x: x IS NOT NULL) AS flags, page_id FROM (SELECT DISTINCT page_id, document_id, coalesce(length(trim(transcription)), 0) AS n, caption FROM page_transcriptions)")
def page_flags(spark, d):
    p = rows(spark, d, "page_transcriptions", "page_id", "document_id", F.coalesce(F.length(F.trim("transcription")), F.lit(0)).alias("n"), "caption")
    n, c = F.col("n"), F.col("caption")
    return p.select("document_id", F.array_compact(F.array(F.when(n == 0, "IMAGE_ONLY"), F.when((n > 0) & (n < 40), "LOW_TEXT"), F.when(c.isNull() | (F.trim(c) == ""), "MISSING_ALT"))).alias("flags"), "page_id")


@query("SELECT page_id, CASE WHEN content_kind = 'NONTECHNICAL' THEN 'exclude' WHEN coalesce(length(trim(transcription)), 0) = 0 THEN 'override' ELSE 'supplement' END AS route FROM (SELECT DISTINCT page_id, content_kind, transcription FROM page_transcriptions)")
def page_routing(spark, d):
    p = rows(spark, d, "page_transcriptions", "page_id", "content_kind", F.coalesce(F.length(F.trim("transcription")), F.lit(0)).alias("n"))
    return p.select("page_id", F.when(F.col("content_kind") == "NONTECHNICAL", "exclude").when(F.col("n") == 0, "override").otherwise("supplement").alias("route"))


# --- numbers and positions -------------------------------------------------------------------------------------


@query("SELECT atom_id, module_id, row_number() OVER (PARTITION BY module_id ORDER BY order_index NULLS FIRST, atom_id) - 1 AS module_no, lag(atom_id) OVER (PARTITION BY module_id ORDER BY order_index NULLS FIRST, atom_id) AS previous_id, lead(atom_id) OVER (PARTITION BY module_id ORDER BY order_index NULLS FIRST, atom_id) AS next_id FROM atoms")
def module_numbers(spark, d):
    a = C.running_number(rows(spark, d, "atom_plans", "atom_id", "module_id", "order_index"), ["module_id"], ["order_index", "atom_id"], "module_no")
    w = W.partitionBy("module_id").orderBy("order_index", "atom_id")
    return a.select("atom_id", "module_id", "module_no", F.lag("atom_id").over(w).alias("previous_id"), F.lead("atom_id").over(w).alias("next_id"))


@query("SELECT atom_id, row_number() OVER (ORDER BY course_id, module_id, atom_id) - 1 AS catalog_no FROM atoms")
def catalog_numbers(spark, d):
    return C.global_number(rows(spark, d, "atom_plans", "atom_id", "course_id", "module_id"), ["course_id", "module_id", "atom_id"], "catalog_no").select("atom_id", "catalog_no")


@query("SELECT module_id, min(order_index) AS lo, max(order_index) AS hi, max(order_index) + 1 = count(*) AND count(DISTINCT order_index) = count(*) AND min(order_index) = 0 AS contiguous FROM atoms GROUP BY module_id")
def order_contiguous(spark, d):
    a = rows(spark, d, "atom_plans", "atom_id", "module_id", "order_index")
    n = F.count(F.lit(1))
    return a.groupBy("module_id").agg(F.min("order_index").alias("lo"), F.max("order_index").alias("hi"), ((F.max("order_index") + 1 == n) & (F.count_distinct("order_index") == n) & (F.min("order_index") == 0)).alias("contiguous"))


@query("SELECT document_id, chunk_id, page_start, expected FROM (SELECT document_id, chunk_id, page_start, coalesce(lag(page_end) OVER (PARTITION BY document_id ORDER BY page_start, page_end, chunk_id) + 1, 1) AS expected FROM ch) WHERE page_start > expected")
def page_gaps(spark, d):
    c = rows(spark, d, "document_chunks", "document_id", "chunk_id", "page_start", "page_end")
    c = C.with_previous(c, ["document_id"], ["page_start", "page_end", "chunk_id"], ["page_end"])
    return c.withColumn("expected", F.coalesce(F.col("prev_page_end") + 1, F.lit(1))).filter("page_start > expected").select("document_id", "chunk_id", "page_start", "expected")


@query("SELECT atom_id, floor((row_number() OVER w - 1) / 4)::BIGINT AS group_no, ntile(3) OVER w AS tile FROM atoms WINDOW w AS (PARTITION BY module_id ORDER BY atom_id)")
def fixed_and_even_groups(spark, d):
    a = rows(spark, d, "atom_plans", "atom_id", "module_id")
    return P.even_groups(P.fixed_groups(a, "module_id", ["atom_id"], 4), "module_id", ["atom_id"], 3).select("atom_id", "group_no", "tile")


@query("SELECT document_id, unnest(list_transform(range(1, greatest(1, page_count) + 1, 8), lambda s: s)) AS page_start FROM docs WHERE page_count IS NOT NULL")
def page_ranges(spark, d):
    t = rows(spark, d, "source_documents", "document_id", "page_count").filter("page_count IS NOT NULL")
    return t.select("document_id", F.explode(P.page_ranges(F.col("page_count"), 8)).alias("r")).select("document_id", F.col("r.page_start").cast("long").alias("page_start"))


@query("SELECT document_id, count(*) AS page_groups, least(5, count(*), greatest(1, ceil(count(*) / 4)))::INT AS atoms, count(*) > least(5, count(*), greatest(1, ceil(count(*) / 4))) * 5 AS over_capacity FROM (SELECT DISTINCT document_id, page_start, page_end FROM ch) GROUP BY document_id")
def atom_counts(spark, d):
    g = tables(spark, d)("document_chunks").select("document_id", "page_start", "page_end").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("page_groups"))
    return g.withColumn("atoms", P.atom_count(F.col("page_groups"), 4)).withColumn("over_capacity", F.col("page_groups") > F.col("atoms") * 5)


def _balanced(most: int = 5, target: int = 4) -> str:
    """The stated rule in SQL, one step a part."""
    sql = f"""w AS (SELECT document_id AS k, page_start AS o, greatest(1, sum(coalesce(length(normalized_text), 0))) AS w FROM ch GROUP BY ALL),
s AS (SELECT k, o, sum(w) OVER p AS upto, row_number() OVER p AS no FROM w WINDOW p AS (PARTITION BY k ORDER BY o NULLS FIRST)),
c0 AS (SELECT k, max(no) AS n, max(upto) AS total, least({most}, max(no), greatest(1, ceil(max(no) / {target})))::BIGINT AS parts, 0::BIGINT AS taken, 0::HUGEINT AS done, [0]::BIGINT[] AS cuts FROM s GROUP BY k)"""
    for p in range(most - 1):
        left = f"(parts - {p})"
        sql += f""",
b{p} AS (SELECT k, min({{'a': abs((upto - done)::DOUBLE - (total - done)::DOUBLE / {left}), 'n': no, 'u': upto}}) AS b FROM c{p} JOIN s USING (k) WHERE {left} > 1 AND no > taken AND no <= n - {left} + 1 GROUP BY k),
c{p + 1} AS (SELECT k, n, total, parts, coalesce(b.n, taken) AS taken, coalesce(b.u, done) AS done, CASE WHEN b IS NULL THEN cuts ELSE list_append(cuts, b.n) END AS cuts FROM c{p} LEFT JOIN b{p} USING (k))"""
    return sql + f" SELECT s.k AS document_id, s.o AS page_start, (len(list_filter(cuts, lambda c: c < no)) - 1)::INT AS part FROM s JOIN c{most - 1} c USING (k)"


@query(_balanced())
def balanced_parts(spark, d):
    c = rows(spark, d, "document_chunks", "chunk_id", "document_id", "page_start", F.coalesce(F.length("normalized_text"), F.lit(0)).alias("n"))
    return P.balanced_parts(c.groupBy("document_id", "page_start").agg(F.sum("n").alias("w")), "document_id", "page_start", "w")


@query("SELECT question_id, 'ABCD'[t + 1] AS target FROM (SELECT question_id, CASE WHEN k < 4 THEN o[k + 1].i ELSE o[((('0x' || left(sha256(atom_id || ':answer-extra'), 2))::INT % 4) + k - 4) % 4 + 1].i END AS t FROM (SELECT question_id, atom_id, row_number() OVER (PARTITION BY atom_id ORDER BY question_id) - 1 AS k, list_sort(list_transform([0, 1, 2, 3], lambda i: {'h': sha256(atom_id || ':answer-order:' || i), 'i': i})) AS o FROM qs))")
def answer_key_order(spark, d):
    q = C.running_number(rows(spark, d, "questions", "question_id", "atom_id"), ["atom_id"], ["question_id"], "k")
    return q.select("question_id", F.substring(F.lit("ABCD"), C.answer_order(F.col("atom_id"), F.col("k").cast("int")) + 1, F.lit(1)).alias("target"))


@query("SELECT question_id, list_transform([0, 1, 2, 3], lambda i: options[(i + (ascii(correct_option_id) - 65) + 4) % 4 + 1].text) AS turned FROM qs WHERE len(options) = 4 AND correct_option_id IN ('A', 'B', 'C', 'D')")
def rotate_options(spark, d):
    q = rows(spark, d, "questions", "question_id", "options", "correct_option_id").filter("size(options) = 4 AND correct_option_id IN ('A', 'B', 'C', 'D')")
    return q.select("question_id", C.rotated(F.transform("options", lambda o: o["text"]), F.ascii("correct_option_id") - 65, F.lit(0)).alias("turned"))


@query("SELECT module_id, run_no, count(*) AS n FROM (SELECT module_id, sum(new) OVER (PARTITION BY module_id ORDER BY atom_id)::BIGINT AS run_no FROM (SELECT module_id, atom_id, (lag(left(title, 1)) OVER w IS DISTINCT FROM left(title, 1) OR row_number() OVER w = 1)::INT AS new FROM atoms WINDOW w AS (PARTITION BY module_id ORDER BY atom_id))) GROUP BY ALL")
def adjacent_runs(spark, d):
    a = rows(spark, d, "atom_plans", "atom_id", "module_id", F.left("title", F.lit(1)).alias("initial"))
    return P.adjacent_runs(a, "module_id", ["atom_id"], "initial").groupBy("module_id", "run_no").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT atom_id, group_order FROM (SELECT a.atom_id, m.g AS group_order, row_number() OVER (ORDER BY m.g, CASE WHEN s.due_at BETWEEN 1 AND 100000 THEN 0 WHEN s.status IS NULL OR s.status = 'NEW' THEN 1 ELSE 2 END, coalesce(s.due_at, 4611686018427387904), coalesce(s.mastery, 0), a.ord, a.atom_id) AS r FROM
(SELECT atom_id, course_id, prerequisite_ids, coalesce(order_index, 0) AS ord FROM atoms) a JOIN (SELECT course_id, row_number() OVER (ORDER BY course_id) - 1 AS g FROM (SELECT DISTINCT course_id FROM atoms)) m USING (course_id)
LEFT JOIN (SELECT DISTINCT atom_id, CASE WHEN estimated_seconds >= 45 THEN 'MASTERED' ELSE 'IN_PROGRESS' END AS status, estimated_seconds * 1000 AS due_at, estimated_seconds / 100 AS mastery FROM les) s USING (atom_id)
WHERE s.status IS DISTINCT FROM 'MASTERED' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(a.prerequisite_ids) AS p) x WHERE p IS NOT NULL AND p NOT IN (SELECT atom_id FROM les WHERE estimated_seconds >= 45))) WHERE r = 1""")
def next_atom(spark, d):
    a = rows(spark, d, "atom_plans", "atom_id", "course_id", "prerequisite_ids", F.coalesce("order_index", F.lit(0)).alias("ord"))
    courses = C.global_number(a.select("course_id").distinct(), ["course_id"], "group_order", buckets=4)
    lessons = rows(spark, d, "lessons", "atom_id", "estimated_seconds")
    state = lessons.select("atom_id", F.when(F.col("estimated_seconds") >= 45, "MASTERED").otherwise("IN_PROGRESS").alias("status"), (F.col("estimated_seconds") * 1000).alias("due_at"), (F.col("estimated_seconds") / 100).alias("mastery"))
    return S.next_item(a.join(courses, "course_id").drop("course_id"), state, 100_000)


# --- graphs ----------------------------------------------------------------------------------------------------


@query("SELECT course_id AS src, module_id AS dst, 'CONTAINS' AS kind FROM atoms UNION SELECT module_id, atom_id, 'CONTAINS' FROM atoms UNION SELECT p, atom_id, 'PREREQUISITE' FROM (SELECT atom_id, unnest(prerequisite_ids) AS p FROM atoms) WHERE p IS NOT NULL")
def graph_edges(spark, d):
    a = rows(spark, d, "atom_plans", "course_id", "module_id", "atom_id", "prerequisite_ids")
    edge = lambda s, t, k, df=a: df.select(F.col(s).alias("src"), F.col(t).alias("dst"), F.lit(k).alias("kind"))
    need = a.select("atom_id", F.explode("prerequisite_ids").alias("p")).filter("p IS NOT NULL")
    return edge("course_id", "module_id", "CONTAINS").unionByName(edge("module_id", "atom_id", "CONTAINS")).unionByName(edge("p", "atom_id", "PREREQUISITE", need)).distinct()


@query("SELECT m.module_id, count(DISTINCT atom_id) AS atoms, count(p) FILTER (inside) AS inner_links, count(p) FILTER (NOT inside) AS incoming FROM (SELECT x.module_id, x.atom_id, x.p, y.module_id = x.module_id AS inside FROM (SELECT module_id, atom_id, unnest(CASE WHEN len(prerequisite_ids) > 0 THEN list_distinct(prerequisite_ids) ELSE [NULL] END) AS p FROM atoms) x LEFT JOIN atoms y ON y.atom_id = x.p) m GROUP BY m.module_id")
def module_projection(spark, d):
    a = rows(spark, d, "atom_plans", "module_id", "atom_id", "prerequisite_ids")
    need = a.select("module_id", "atom_id", F.explode_outer(F.array_distinct("prerequisite_ids")).alias("p"))
    j = need.join(a.select(F.col("atom_id").alias("p"), F.col("module_id").alias("pm")), "p", "left").withColumn("inside", F.col("pm") == F.col("module_id"))
    return j.groupBy("module_id").agg(F.count_distinct("atom_id").alias("atoms"), F.count(F.when(F.col("inside"), F.col("p"))).alias("inner_links"), F.count(F.when(~F.col("inside"), F.col("p"))).alias("incoming"))


@query("SELECT pair_id, count(DISTINCT r) AS evidence FROM (SELECT pair_id, unnest(source_ref_ids) AS r FROM les UNION ALL SELECT pair_id, unnest(source_ref_ids) FROM qs) GROUP BY pair_id")
def evidence_sets(spark, d):
    one = lambda t: tables(spark, d)(t).select("pair_id", F.explode("source_ref_ids").alias("r"))
    return one("lessons").unionByName(one("questions")).groupBy("pair_id").agg(F.count_distinct("r").alias("evidence"))
