"""The rule registry of the content tables, as one issues table and per rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonloom.functions.hashing import digest
from lessonloom.functions.text import words
from lessonloom.operators import quality as Q
from lessonloom.operators.editorial import action_pattern, observable
from lessonloom.runtime import tables

KEYS = {"atom_plans": "atom_id", "lessons": "lesson_id", "learning_pairs": "pair_id", "questions": "question_id", "illustration_assets": "illustration_id", "document_chunks": "chunk_id", "source_documents": "document_id"}

_c = F.col
_blank = lambda x: F.trim(F.coalesce(_c(x), F.lit(""))) == ""


def _n_words(x: str):
    return F.size(words(F.coalesce(_c(x), F.lit(""))))


#: The text a learner reads in a lesson.
_TEXT = ("learning_objective", "hook", "intuition", "common_mistake", "recall_prompt")


#: code: (rule, the SQL that gives code, path, detail, severity)
def rules() -> dict[str, object]:
    """All rules by code."""
    ref = _c("source_ref.source_ref_id")
    own = [
        Q.RowRule("ILLUSTRATION_MEMBER_INVALID", "illustration_assets", ~_c("asset_member").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]*\.(?:png|webp)$")),
        Q.RowRule("ILLUSTRATION_MIME_INVALID", "illustration_assets", ~_c("mime_type").isin("image/png", "image/webp")),
        Q.RowRule("ILLUSTRATION_MIME_MISMATCH", "illustration_assets", ((_c("mime_type") == "image/png") & ~F.lower("asset_member").endswith(".png")) | ((_c("mime_type") == "image/webp") & ~F.lower("asset_member").endswith(".webp"))),
        Q.RowRule("ILLUSTRATION_HASH_INVALID", "illustration_assets", ~_c("sha256").rlike("^sha256:[0-9a-f]{64}$")),
        Q.RowRule("ILLUSTRATION_SIZE_INVALID", "illustration_assets", ~_c("byte_size").between(1, 16 << 20), _c("byte_size")),
        Q.RowRule("ILLUSTRATION_DIMENSIONS_INVALID", "illustration_assets", ~_c("width").between(1, 8192) | ~_c("height").between(1, 8192)),
        Q.RowRule("ILLUSTRATION_PIXELS_INVALID", "illustration_assets", _c("width").between(1, 8192) & _c("height").between(1, 8192) & (_c("width").cast("long") * _c("height") > 16_777_216)),
        Q.RowRule("ILLUSTRATION_PAGE_INVALID", "illustration_assets", _c("page_number") < 1, _c("page_number")),
        Q.RowRule("ILLUSTRATION_CAPTION_EMPTY", "illustration_assets", _blank("caption")),
        Q.RowRule("ILLUSTRATION_ALT_TEXT_EMPTY", "illustration_assets", _blank("alt_text")),
        Q.UniqueRule("ILLUSTRATION_MEMBER_DUPLICATE", "illustration_assets", _c("asset_member")),
        Q.ReferenceRule("ILLUSTRATION_SOURCE_UNKNOWN", "illustration_assets", "source_ref_id", "document_chunks", ref),
        Q.MatchRule("ILLUSTRATION_PAGE_OUTSIDE_SOURCE", "illustration_assets", "source_ref_id", "document_chunks", ref, {"lo": _c("source_ref.page_start"), "hi": _c("source_ref.page_end")}, (_c("page_number") >= 1) & ~_c("page_number").between(_c("t_lo"), _c("t_hi"))),
        Q.ReferenceRule("ATOM_PLAN_SOURCE_UNKNOWN", "atom_plans", "source_ref_ids", "document_chunks", ref),
        Q.ReferenceRule("ATOM_PREREQUISITE_UNKNOWN", "atom_plans", "prerequisite_ids", "atom_plans", _c("atom_id")),
        Q.RowRule("ATOM_PREREQUISITE_REPEATED", "atom_plans", F.size(F.array_compact("prerequisite_ids")) != F.size(F.array_distinct(F.array_compact("prerequisite_ids")))),
        Q.RowRule("ATOM_PREREQUISITE_NULL", "atom_plans", F.exists("prerequisite_ids", lambda x: x.isNull())),
        Q.RowRule("ATOM_SOURCE_REQUIRED", "atom_plans", F.size(F.coalesce("source_ref_ids", F.array().cast("array<string>"))) == 0),
        Q.RowRule("ATOM_ORDER_MISSING", "atom_plans", _c("order_index").isNull(), severity="WARNING"),
        Q.ReferenceRule("LESSON_ATOM_UNKNOWN", "lessons", "atom_id", "atom_plans", _c("atom_id")),
        Q.ReferenceRule("LESSON_PAIR_MISSING", "lessons", "pair_id", "learning_pairs", _c("pair_id")),
        Q.ReferenceRule("LESSON_SOURCE_UNKNOWN", "lessons", "source_ref_ids", "document_chunks", ref),
        Q.ReferenceRule("LESSON_ILLUSTRATION_ASSET_MISSING", "lessons", "illustration_source_ref_ids", "illustration_assets", _c("source_ref_id")),
        Q.MatchRule("LESSON_PREREQUISITE_MISMATCH", "lessons", "atom_id", "atom_plans", _c("atom_id"), {"need": _c("prerequisite_ids")}, ~_c("prerequisite_ids").eqNullSafe(_c("t_need"))),
        Q.MatchRule("LESSON_SOURCE_PLAN_MISMATCH", "lessons", "atom_id", "atom_plans", _c("atom_id"), {"src": _c("source_ref_ids")}, ~_c("source_ref_ids").eqNullSafe(_c("t_src"))),
        Q.RowRule("LESSON_OBJECTIVE_TOO_THIN", "lessons", _n_words("learning_objective") < 6, severity="WARNING"),
        Q.RowRule("LESSON_HOOK_TOO_THIN", "lessons", _n_words("hook") < 10, severity="WARNING"),
        Q.RowRule("LESSON_INTUITION_TOO_THIN", "lessons", _n_words("intuition") < 30, severity="WARNING"),
        Q.RowRule("LESSON_TAKEAWAYS_COUNT", "lessons", ~F.size("takeaways").between(1, 3), F.size("takeaways")),
        Q.RowRule("LESSON_SECONDS_INVALID", "lessons", ~_c("estimated_seconds").between(30, 90), _c("estimated_seconds")),
        Q.RowRule("LESSON_ILLUSTRATION_DUPLICATE", "lessons", F.size("illustration_source_ref_ids") != F.size(F.array_distinct("illustration_source_ref_ids"))),
        Q.ReferenceRule("PAIR_ATOM_UNKNOWN", "learning_pairs", "atom_id", "atom_plans", _c("atom_id")),
        Q.ReferenceRule("PAIR_LESSON_MISSING", "learning_pairs", "micro_lesson_id", "lessons", _c("lesson_id")),
        Q.ReferenceRule("PAIR_QUESTION_MISSING", "learning_pairs", "question_ids", "questions", _c("question_id")),
        Q.MatchRule("PAIR_ATOM_MISMATCH", "learning_pairs", "micro_lesson_id", "lessons", _c("lesson_id"), {"atom": _c("atom_id")}, _c("atom_id") != _c("t_atom")),
        Q.RowRule("PAIR_DUPLICATE_QUESTION", "learning_pairs", F.size("question_ids") != F.size(F.array_distinct("question_ids"))),
        Q.RowRule("PAIR_TOO_FEW_QUESTIONS", "learning_pairs", F.size("question_ids") < 3, F.size("question_ids")),
        Q.CountRule("QUESTION_MULTIPLE_PAIRS", "questions", "learning_pairs", "question_ids", 0, 1),
        Q.CountRule("LESSON_PAIR_COVERAGE", "lessons", "learning_pairs", "micro_lesson_id", 1, 1),
        Q.ReferenceRule("QUESTION_PAIR_UNKNOWN", "questions", "pair_id", "learning_pairs", _c("pair_id")),
        Q.ReferenceRule("QUESTION_SOURCE_UNKNOWN", "questions", "source_ref_ids", "document_chunks", ref),
        Q.MatchRule("QUESTION_PAIR_MISMATCH", "questions", "pair_id", "learning_pairs", _c("pair_id"), {"atom": _c("atom_id")}, _c("atom_id") != _c("t_atom")),
        Q.MatchRule("QUESTION_SOURCE_PLAN_MISMATCH", "questions", "atom_id", "atom_plans", _c("atom_id"), {"src": _c("source_ref_ids")}, F.size(F.array_except("source_ref_ids", F.coalesce("t_src", F.array().cast("array<string>")))) > 0),
        Q.RowRule("OPTION_IDS_INVALID", "questions", F.transform("options", lambda o: o["id"]) != F.array(*[F.lit(x) for x in "ABCD"])),
        Q.RowRule("DUPLICATE_OPTION", "questions", F.size(F.array_distinct(F.transform("options", lambda o: F.lower(F.trim(o["text"]))))) != F.size("options")),
        Q.RowRule("CORRECT_OPTION_MISSING", "questions", ~F.array_contains(F.transform("options", lambda o: o["id"]), _c("correct_option_id"))),
        Q.RowRule("QUESTION_SOURCE_REQUIRED", "questions", (_c("grounding_type") == "SOURCE_GROUNDED") & (F.size(F.coalesce("source_ref_ids", F.array().cast("array<string>"))) == 0)),
        Q.RowRule("QUESTION_DIFFICULTY_INVALID", "questions", ~_c("difficulty").between(1, 5), _c("difficulty")),
        Q.RowRule("SOURCE_PAGE_INVALID", "document_chunks", (_c("source_ref.page_start") < 1) | (_c("source_ref.page_end") < _c("source_ref.page_start"))),
        Q.RowRule("SOURCE_ANCHOR_INVALID", "document_chunks", (_c("source_ref.anchor_start") < 0) | (_c("source_ref.anchor_end") < _c("source_ref.anchor_start"))),
        Q.RowRule("CHUNK_HASH_INVALID", "document_chunks", ~_c("text_hash").eqNullSafe(digest(_c("normalized_text")))),
        Q.RowRule("CHUNK_SOURCE_MISMATCH", "document_chunks", (_c("source_ref.document_id") != _c("document_id")) | (_c("source_ref.chunk_id") != _c("chunk_id"))),
        Q.RowRule("CHUNK_TEXT_EMPTY", "document_chunks", _blank("normalized_text")),
        Q.ReferenceRule("CHUNK_DOCUMENT_UNKNOWN", "document_chunks", "document_id", "source_documents", _c("document_id")),
        Q.UniqueRule("DOCUMENT_BYTES_DUPLICATE", "source_documents", _c("sha256"), severity="WARNING"),
        Q.ReferenceRule("ATOM_FULL_LESSON_MISSING", "atom_plans", "atom_id", "lessons", _c("atom_id")),
        Q.CountRule("ATOM_PAIR_COVERAGE_INVALID", "atom_plans", "learning_pairs", "atom_id", 1, 1),
        Q.UniqueRule("FULL_LESSON_DUPLICATE_ATOM", "lessons", _c("atom_id")),
        Q.UniqueRule("LESSON_MULTIPLE_PAIRS", "learning_pairs", _c("micro_lesson_id")),
        Q.MatchRule("LESSON_PAIR_MISMATCH", "lessons", "pair_id", "learning_pairs", _c("pair_id"), {"lesson": _c("micro_lesson_id")}, _c("lesson_id") != _c("t_lesson")),
        Q.ReferenceRule("QUESTION_PAIR_MISSING", "questions", "question_id", "learning_pairs", F.explode("question_ids")),
        Q.ReferenceRule("ILLUSTRATION_UNUSED", "illustration_assets", "source_ref_id", "lessons", F.explode("illustration_source_ref_ids")),
        Q.RowRule("PAIR_CONTENT_HASH_INVALID", "learning_pairs", _c("content_hash") != F.concat(F.lit("sha256:"), F.sha2(F.array_join("question_ids", "\x1f").cast("binary"), 256))),
        Q.RowRule("LESSON_COMMON_MISTAKE_TOO_THIN", "lessons", _n_words("common_mistake") < 8, severity="WARNING"),
        Q.RowRule("LESSON_RECALL_PROMPT_TOO_THIN", "lessons", _n_words("recall_prompt") < 5, severity="WARNING"),
        Q.RowRule("LESSON_TITLE_LENGTH_INVALID", "lessons", ~_n_words("title").between(2, 14), severity="WARNING"),
        Q.RowRule("LESSON_TITLE_PAGE_LABEL", "lessons", _c("title").rlike(r"(?i)(?:trang|slide|page)\s*\d+"), severity="WARNING"),
        Q.RowRule("LESSON_EXAMPLE_STEPS_TOO_FEW", "lessons", F.size(_c("tiny_example.steps")) < 2, F.size(_c("tiny_example.steps")), severity="WARNING"),
        Q.RowRule("LESSON_EXAMPLE_TOO_THIN", "lessons", F.size(words(F.concat_ws(" ", "tiny_example.input", F.array_join("tiny_example.steps", " "), "tiny_example.output"))) < 20, severity="WARNING"),
        Q.RowRule("LESSON_PROCESS_STEPS_TOO_FEW", "lessons", F.size("process_steps") < 2, F.size("process_steps"), severity="WARNING"),
        Q.RowRule("LESSON_PROCESS_STEPS_EXCESSIVE", "lessons", F.size("process_steps") > 8, F.size("process_steps"), severity="WARNING"),
        Q.RowRule("LESSON_TAKEAWAYS_DUPLICATE", "lessons", F.size(F.array_distinct(F.transform("takeaways", lambda t: F.lower(F.trim(t))))) != F.size("takeaways"), severity="WARNING"),
        Q.RowRule("LESSON_TEXT_EXCESSIVE", "lessons", F.size(words(F.concat_ws(" ", *_TEXT))) > 520, severity="WARNING"),
        Q.RowRule("LESSON_TEXT_TOO_THIN", "lessons", F.size(words(F.concat_ws(" ", *_TEXT))) < 140, severity="WARNING"),
        Q.RowRule("LESSON_OBJECTIVE_NOT_OBSERVABLE", "lessons", ~observable(_c("learning_objective")), severity="WARNING"),
        Q.RowRule("DOCUMENT_PAGES_INVALID", "source_documents", _c("page_count") < 1, _c("page_count")),
    ]
    return {r.code: r for r in own}


def _found(spark, d):
    t = tables(spark, d)
    return Q.issues({n: t(n) for n in KEYS}, KEYS, list(rules().values()))


def quality_issues(spark, d):
    return _found(spark, d)


def quality_verdict(spark, d):
    return Q.verdict(_found(spark, d))


_REF = "SELECT source_ref.source_ref_id FROM document_chunks WHERE source_ref.source_ref_id IS NOT NULL"
_W = r"len(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_]+'))"


def _row(code, table, key, where, detail="NULL", severity="ERROR"):
    return f"SELECT DISTINCT '{code}' AS code, '{table}:' || {key} AS path, ({detail})::VARCHAR AS detail, '{severity}' AS severity FROM {table} WHERE {where}"


def _lost(code, table, key, ids, target):
    return f"SELECT DISTINCT '{code}', '{table}:' || k, r, 'ERROR' FROM (SELECT {key} AS k, {ids} AS r FROM {table}) WHERE r IS NOT NULL AND r NOT IN ({target})"


def _match(code, table, key, field, target, target_key, broken):
    return f"SELECT DISTINCT '{code}', '{table}:' || x.{key}, x.{field}, 'ERROR' FROM {table} x JOIN {target} y ON x.{field} = y.{target_key} WHERE {broken}"


_OPT = "list_transform(options, lambda o: {0})"
_PARTS = [
    _row("ILLUSTRATION_MEMBER_INVALID", "illustration_assets", "illustration_id", r"NOT regexp_full_match(asset_member, '[A-Za-z0-9][A-Za-z0-9_.-]*\.(?:png|webp)')"),
    _row("ILLUSTRATION_MIME_INVALID", "illustration_assets", "illustration_id", "mime_type NOT IN ('image/png', 'image/webp')"),
    _row("ILLUSTRATION_MIME_MISMATCH", "illustration_assets", "illustration_id", "(mime_type = 'image/png' AND NOT lower(asset_member) LIKE '%.png') OR (mime_type = 'image/webp' AND NOT lower(asset_member) LIKE '%.webp')"),
    _row("ILLUSTRATION_HASH_INVALID", "illustration_assets", "illustration_id", "NOT regexp_full_match(sha256, 'sha256:[0-9a-f]{64}')"),
    _row("ILLUSTRATION_SIZE_INVALID", "illustration_assets", "illustration_id", "NOT byte_size BETWEEN 1 AND 16777216", "byte_size"),
    _row("ILLUSTRATION_DIMENSIONS_INVALID", "illustration_assets", "illustration_id", "NOT width BETWEEN 1 AND 8192 OR NOT height BETWEEN 1 AND 8192"),
    _row("ILLUSTRATION_PIXELS_INVALID", "illustration_assets", "illustration_id", "width BETWEEN 1 AND 8192 AND height BETWEEN 1 AND 8192 AND width::BIGINT * height > 16777216"),
    _row("ILLUSTRATION_PAGE_INVALID", "illustration_assets", "illustration_id", "page_number < 1", "page_number"),
    _row("ILLUSTRATION_CAPTION_EMPTY", "illustration_assets", "illustration_id", "trim(coalesce(caption, '')) = ''"),
    _row("ILLUSTRATION_ALT_TEXT_EMPTY", "illustration_assets", "illustration_id", "trim(coalesce(alt_text, '')) = ''"),
    "SELECT 'ILLUSTRATION_MEMBER_DUPLICATE', 'illustration_assets:' || asset_member, count(DISTINCT illustration_id)::VARCHAR, 'ERROR' FROM illustration_assets WHERE asset_member IS NOT NULL GROUP BY asset_member HAVING count(DISTINCT illustration_id) > 1",
    _lost("ILLUSTRATION_SOURCE_UNKNOWN", "illustration_assets", "illustration_id", "source_ref_id", _REF),
    "SELECT DISTINCT 'ILLUSTRATION_PAGE_OUTSIDE_SOURCE', 'illustration_assets:' || x.illustration_id, x.source_ref_id, 'ERROR' FROM illustration_assets x JOIN document_chunks y ON y.source_ref.source_ref_id = x.source_ref_id WHERE x.page_number >= 1 AND NOT x.page_number BETWEEN y.source_ref.page_start AND y.source_ref.page_end",
    _lost("ATOM_PLAN_SOURCE_UNKNOWN", "atom_plans", "atom_id", "unnest(source_ref_ids)", _REF),
    _lost("ATOM_PREREQUISITE_UNKNOWN", "atom_plans", "atom_id", "unnest(prerequisite_ids)", "SELECT atom_id FROM atom_plans"),
    _row("ATOM_PREREQUISITE_REPEATED", "atom_plans", "atom_id", "len(list_filter(prerequisite_ids, lambda x: x IS NOT NULL)) <> len(list_distinct(prerequisite_ids))"),
    _row("ATOM_PREREQUISITE_NULL", "atom_plans", "atom_id", "len(list_filter(prerequisite_ids, lambda x: x IS NULL)) > 0"),
    _row("ATOM_SOURCE_REQUIRED", "atom_plans", "atom_id", "coalesce(len(source_ref_ids), 0) = 0"),
    _row("ATOM_ORDER_MISSING", "atom_plans", "atom_id", "order_index IS NULL", severity="WARNING"),
    _lost("LESSON_ATOM_UNKNOWN", "lessons", "lesson_id", "atom_id", "SELECT atom_id FROM atom_plans"),
    _lost("LESSON_PAIR_MISSING", "lessons", "lesson_id", "pair_id", "SELECT pair_id FROM learning_pairs"),
    _lost("LESSON_SOURCE_UNKNOWN", "lessons", "lesson_id", "unnest(source_ref_ids)", _REF),
    _lost("LESSON_ILLUSTRATION_ASSET_MISSING", "lessons", "lesson_id", "unnest(illustration_source_ref_ids)", "SELECT source_ref_id FROM illustration_assets WHERE source_ref_id IS NOT NULL"),
    _match("LESSON_PREREQUISITE_MISMATCH", "lessons", "lesson_id", "atom_id", "atom_plans", "atom_id", "x.prerequisite_ids IS DISTINCT FROM y.prerequisite_ids"),
    _match("LESSON_SOURCE_PLAN_MISMATCH", "lessons", "lesson_id", "atom_id", "atom_plans", "atom_id", "x.source_ref_ids IS DISTINCT FROM y.source_ref_ids"),
    _row("LESSON_OBJECTIVE_TOO_THIN", "lessons", "lesson_id", _W.format("learning_objective") + " < 6", severity="WARNING"),
    _row("LESSON_HOOK_TOO_THIN", "lessons", "lesson_id", _W.format("hook") + " < 10", severity="WARNING"),
    _row("LESSON_INTUITION_TOO_THIN", "lessons", "lesson_id", _W.format("intuition") + " < 30", severity="WARNING"),
    _row("LESSON_TAKEAWAYS_COUNT", "lessons", "lesson_id", "NOT len(takeaways) BETWEEN 1 AND 3", "len(takeaways)"),
    _row("LESSON_SECONDS_INVALID", "lessons", "lesson_id", "NOT estimated_seconds BETWEEN 30 AND 90", "estimated_seconds"),
    _row("LESSON_ILLUSTRATION_DUPLICATE", "lessons", "lesson_id", "len(illustration_source_ref_ids) <> len(list_distinct(illustration_source_ref_ids))"),
    _lost("PAIR_ATOM_UNKNOWN", "learning_pairs", "pair_id", "atom_id", "SELECT atom_id FROM atom_plans"),
    _lost("PAIR_LESSON_MISSING", "learning_pairs", "pair_id", "micro_lesson_id", "SELECT lesson_id FROM lessons"),
    _lost("PAIR_QUESTION_MISSING", "learning_pairs", "pair_id", "unnest(question_ids)", "SELECT question_id FROM questions"),
    _match("PAIR_ATOM_MISMATCH", "learning_pairs", "pair_id", "micro_lesson_id", "lessons", "lesson_id", "x.atom_id <> y.atom_id"),
    _row("PAIR_DUPLICATE_QUESTION", "learning_pairs", "pair_id", "len(question_ids) <> len(list_distinct(question_ids)) + (len(list_filter(question_ids, lambda x: x IS NULL)) > 0)::INT"),
    _row("PAIR_TOO_FEW_QUESTIONS", "learning_pairs", "pair_id", "len(question_ids) < 3", "len(question_ids)"),
    "SELECT 'QUESTION_MULTIPLE_PAIRS', 'questions:' || question_id, n::VARCHAR, 'ERROR' FROM (SELECT DISTINCT question_id FROM questions) JOIN (SELECT r AS question_id, count(*) AS n FROM (SELECT unnest(question_ids) AS r FROM (SELECT DISTINCT pair_id, question_ids FROM learning_pairs)) GROUP BY r) USING (question_id) WHERE n > 1",
    "SELECT 'LESSON_PAIR_COVERAGE', 'lessons:' || lesson_id, coalesce(n, 0)::VARCHAR, 'ERROR' FROM (SELECT DISTINCT lesson_id FROM lessons) LEFT JOIN (SELECT micro_lesson_id AS lesson_id, count(DISTINCT pair_id) AS n FROM learning_pairs GROUP BY 1) USING (lesson_id) WHERE coalesce(n, 0) <> 1",
    _lost("QUESTION_PAIR_UNKNOWN", "questions", "question_id", "pair_id", "SELECT pair_id FROM learning_pairs"),
    _lost("QUESTION_SOURCE_UNKNOWN", "questions", "question_id", "unnest(source_ref_ids)", _REF),
    _match("QUESTION_PAIR_MISMATCH", "questions", "question_id", "pair_id", "learning_pairs", "pair_id", "x.atom_id <> y.atom_id"),
    _match("QUESTION_SOURCE_PLAN_MISMATCH", "questions", "question_id", "atom_id", "atom_plans", "atom_id", "len(list_filter(x.source_ref_ids, lambda r: NOT list_contains(coalesce(y.source_ref_ids, []), r))) > 0"),
    _row("OPTION_IDS_INVALID", "questions", "question_id", _OPT.format("o.id") + " <> ['A', 'B', 'C', 'D']"),
    _row("DUPLICATE_OPTION", "questions", "question_id", "len(list_distinct(" + _OPT.format("lower(trim(o.text))") + ")) <> len(options)"),
    _row("CORRECT_OPTION_MISSING", "questions", "question_id", "NOT list_contains(" + _OPT.format("o.id") + ", correct_option_id)"),
    _row("QUESTION_SOURCE_REQUIRED", "questions", "question_id", "grounding_type = 'SOURCE_GROUNDED' AND coalesce(len(source_ref_ids), 0) = 0"),
    _row("QUESTION_DIFFICULTY_INVALID", "questions", "question_id", "NOT difficulty BETWEEN 1 AND 5", "difficulty"),
    _row("SOURCE_PAGE_INVALID", "document_chunks", "chunk_id", "source_ref.page_start < 1 OR source_ref.page_end < source_ref.page_start"),
    _row("SOURCE_ANCHOR_INVALID", "document_chunks", "chunk_id", "source_ref.anchor_start < 0 OR source_ref.anchor_end < source_ref.anchor_start"),
    _row("CHUNK_HASH_INVALID", "document_chunks", "chunk_id", "text_hash IS DISTINCT FROM 'sha256:' || sha256(normalized_text)"),
    _row("CHUNK_SOURCE_MISMATCH", "document_chunks", "chunk_id", "source_ref.document_id <> document_id OR source_ref.chunk_id <> chunk_id"),
    _row("CHUNK_TEXT_EMPTY", "document_chunks", "chunk_id", "trim(coalesce(normalized_text, '')) = ''"),
    _lost("CHUNK_DOCUMENT_UNKNOWN", "document_chunks", "chunk_id", "document_id", "SELECT document_id FROM source_documents WHERE document_id IS NOT NULL"),
    "SELECT 'DOCUMENT_BYTES_DUPLICATE', 'source_documents:' || sha256, count(DISTINCT document_id)::VARCHAR, 'WARNING' FROM source_documents WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT document_id) > 1",
    _lost("ATOM_FULL_LESSON_MISSING", "atom_plans", "atom_id", "atom_id", "SELECT atom_id FROM lessons WHERE atom_id IS NOT NULL"),
    "SELECT 'ATOM_PAIR_COVERAGE_INVALID', 'atom_plans:' || atom_id, coalesce(n, 0)::VARCHAR, 'ERROR' FROM (SELECT DISTINCT atom_id FROM atom_plans) LEFT JOIN (SELECT atom_id, count(DISTINCT pair_id) AS n FROM learning_pairs GROUP BY 1) USING (atom_id) WHERE coalesce(n, 0) <> 1",
    "SELECT 'FULL_LESSON_DUPLICATE_ATOM', 'lessons:' || atom_id, count(DISTINCT lesson_id)::VARCHAR, 'ERROR' FROM lessons WHERE atom_id IS NOT NULL GROUP BY atom_id HAVING count(DISTINCT lesson_id) > 1",
    "SELECT 'LESSON_MULTIPLE_PAIRS', 'learning_pairs:' || micro_lesson_id, count(DISTINCT pair_id)::VARCHAR, 'ERROR' FROM learning_pairs WHERE micro_lesson_id IS NOT NULL GROUP BY micro_lesson_id HAVING count(DISTINCT pair_id) > 1",
    _match("LESSON_PAIR_MISMATCH", "lessons", "lesson_id", "pair_id", "learning_pairs", "pair_id", "x.lesson_id <> y.micro_lesson_id"),
    _lost("QUESTION_PAIR_MISSING", "questions", "question_id", "question_id", "SELECT r FROM (SELECT unnest(question_ids) AS r FROM learning_pairs) WHERE r IS NOT NULL"),
    _lost("ILLUSTRATION_UNUSED", "illustration_assets", "illustration_id", "source_ref_id", "SELECT r FROM (SELECT unnest(illustration_source_ref_ids) AS r FROM lessons) WHERE r IS NOT NULL"),
    _row("PAIR_CONTENT_HASH_INVALID", "learning_pairs", "pair_id", "content_hash <> 'sha256:' || sha256(array_to_string(question_ids, chr(31)))"),
    _row("LESSON_COMMON_MISTAKE_TOO_THIN", "lessons", "lesson_id", _W.format("common_mistake") + " < 8", severity="WARNING"),
    _row("LESSON_RECALL_PROMPT_TOO_THIN", "lessons", "lesson_id", _W.format("recall_prompt") + " < 5", severity="WARNING"),
    _row("LESSON_TITLE_LENGTH_INVALID", "lessons", "lesson_id", "NOT " + _W.format("title") + " BETWEEN 2 AND 14", severity="WARNING"),
    _row("LESSON_TITLE_PAGE_LABEL", "lessons", "lesson_id", r"regexp_matches(title, '(?i)(?:trang|slide|page)\s*\d+')", severity="WARNING"),
    _row("LESSON_EXAMPLE_STEPS_TOO_FEW", "lessons", "lesson_id", "len(tiny_example.steps) < 2", "len(tiny_example.steps)", severity="WARNING"),
    _row("LESSON_EXAMPLE_TOO_THIN", "lessons", "lesson_id", _W.format("concat_ws(' ', tiny_example.input, array_to_string(tiny_example.steps, ' '), tiny_example.output)") + " < 20", severity="WARNING"),
    _row("LESSON_PROCESS_STEPS_TOO_FEW", "lessons", "lesson_id", "len(process_steps) < 2", "len(process_steps)", severity="WARNING"),
    _row("LESSON_PROCESS_STEPS_EXCESSIVE", "lessons", "lesson_id", "len(process_steps) > 8", "len(process_steps)", severity="WARNING"),
    _row("LESSON_TAKEAWAYS_DUPLICATE", "lessons", "lesson_id", "len(list_distinct(list_transform(takeaways, lambda t: lower(trim(t))))) <> len(takeaways)", severity="WARNING"),
    _row("LESSON_TEXT_EXCESSIVE", "lessons", "lesson_id", _W.format(f"concat_ws(' ', {', '.join(_TEXT)})") + " > 520", severity="WARNING"),
    _row("LESSON_TEXT_TOO_THIN", "lessons", "lesson_id", _W.format(f"concat_ws(' ', {', '.join(_TEXT)})") + " < 140", severity="WARNING"),
    _row("LESSON_OBJECTIVE_NOT_OBSERVABLE", "lessons", "lesson_id", f"NOT regexp_matches(learning_objective, '(?i){action_pattern('($|[^' + chr(92) + 'p{L}' + chr(92) + 'p{M}' + chr(92) + 'p{N}_])')}')", severity="WARNING"),
    _row("DOCUMENT_PAGES_INVALID", "source_documents", "document_id", "page_count < 1", "page_count"),
]
_ALL = " UNION ALL ".join(f"({p})" for p in _PARTS)

QUERIES = {f.__name__: f for f in (quality_issues, quality_verdict)}
SQL = {"quality_issues": _ALL, "quality_verdict": f"SELECT code, severity, count(*) AS issues FROM ({_ALL}) GROUP BY ALL"}
