"""Queries over text rules, payloads, reviews, page scores and partitions of ordered data."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonloom.functions.text import nfc
from lessonloom.operators import content as C
from lessonloom.operators import memo
from lessonloom.operators import partitioning as P
from lessonloom.operators import texts as X
from lessonloom.plans.content import _VIEWS, rows
from lessonloom.runtime import tables
from lessonloom.streaming import signals

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {_VIEWS} {sql}"
        return f

    return add


@query(r"SELECT lesson_id, pos::BIGINT AS pos, CASE WHEN length(t) > 500 THEN 'TOO_LONG' WHEN regexp_matches(rtrim(t), '[,;:]$') THEN 'CUT_OFF' WHEN (length(t) - length(replace(t, '\"', ''))) % 2 = 1 THEN 'ODD_QUOTES' END AS problem FROM (SELECT lesson_id, unnest(takeaways) AS t, generate_subscripts(takeaways, 1) - 1 AS pos FROM les)".replace('\\"', '"'))
def takeaway_rules(spark, d):
    t = rows(spark, d, "lessons", "lesson_id", "takeaways").select("lesson_id", F.posexplode("takeaways").alias("pos", "t"))
    return t.select("lesson_id", F.col("pos").cast("long").alias("pos"), X.takeaway_problem(F.col("t")).alias("problem"))


@query(r"SELECT lesson_id, list_transform(takeaways, lambda t: regexp_replace(t, '([\p{Ll}\d][.!?])(\p{Lu})', '\1 \2', 'g')) AS takeaways FROM les")
def spaced_takeaways(spark, d):
    t = rows(spark, d, "lessons", "lesson_id", "takeaways")
    return t.select("lesson_id", F.transform("takeaways", X.spaced_sentences).alias("takeaways"))


@query(r"SELECT lesson_id, trim(regexp_replace(lower(nfc_normalize(step)), '[^\p{L}\p{N}]+', ' ', 'g')) AS k, min(pos) AS first_pos, count(*) AS n FROM (SELECT DISTINCT lesson_id, unnest(process_steps) AS step, generate_subscripts(process_steps, 1)::INT - 1 AS pos FROM lessons) GROUP BY lesson_id, k")
def heading_keys(spark, d):
    """Steps that repeat an earlier one of their lesson, by normalised words: the index of the first is kept."""
    t = tables(spark, d)("lessons").select("lesson_id", F.posexplode("process_steps").alias("pos", "step")).distinct()
    keyed = t.withColumn("k", X.heading_key(F.col("step")))
    return keyed.groupBy("lesson_id", "k").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))


@query()
def learner_text(spark, d):
    return tables(spark, d)("documents").select("doc_id", X.plain_learner_text(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\bgradient\b') AND regexp_matches(text, '(?i)\bdropout\b') AS mixed FROM documents WHERE text IS NOT NULL")
def mixed_terms(spark, d):
    return tables(spark, d)("documents").filter("text IS NOT NULL").select("doc_id", X.both(F.col("text"), r"(?i)\bgradient\b", r"(?i)\bdropout\b").alias("mixed"))


@query()
def joined_tokens(spark, d):
    t = tables(spark, d)("document_chunks").filter("normalized_text IS NOT NULL").select("chunk_id", nfc(F.col("normalized_text")).alias("x"))
    return t.select("chunk_id", X.joined_words(F.col("x"), ("của", "được", "trong", "không"), ("mô", "dữ", "học", "và")).alias("joined"))


@query("SELECT event_id, '{' || split_part(split_part(props, '{', 2), '}', 1) || '}' AS payload FROM events WHERE props LIKE '%{%}%'")
def json_payloads(spark, d):
    fenced = F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n```"))
    return tables(spark, d)("events").filter("props LIKE '%{%}%'").select("event_id", X.json_payload(fenced).alias("payload"))


@query("SELECT event_id, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL THEN ['k', 'missing'] ELSE ['missing'] END AS problems FROM events WHERE props IS NOT NULL")
def json_problems(spark, d):
    return tables(spark, d)("events").filter("props IS NOT NULL").select("event_id", X.schema_problems(F.col("props"), {"k": "bigint", "missing": "string"}).alias("problems"))


@query("SELECT event_id, json_keys(props) AS keys FROM events WHERE props IS NOT NULL")
def json_key_scan(spark, d):
    return tables(spark, d)("events").filter("props IS NOT NULL").select("event_id", F.json_object_keys("props").alias("keys"))


@query()
def formula_texts(spark, d):
    t = tables(spark, d)("lessons").select("lesson_id", F.posexplode("formula_blocks").alias("pos", "b")).select("lesson_id", "pos", "b.latex").distinct()
    return t.select("lesson_id", "pos", X.formula(F.col("latex")).alias("shown"))


@query(r"SELECT question_id, count(*) AS options, count(DISTINCT CASE WHEN regexp_matches(t, '[`(){}\[\]=]|\w\.\w') THEN k ELSE lower(k) END) AS different FROM (SELECT question_id, o.text AS t, trim(regexp_replace(nfc_normalize(o.text), '\s+', ' ', 'g')) AS k FROM (SELECT question_id, unnest(options) AS o FROM qs)) GROUP BY question_id")
def option_duplicates(spark, d):
    """Options of each question and how many stay different aside from case and spacing; those with code keep their case."""
    q = rows(spark, d, "questions", "question_id", "options").select("question_id", F.explode("options").alias("o"))
    k = X.option_key(F.col("o.text"), F.col("o.text").rlike(r"[`(){}\[\]=]|\w\.\w"))
    return q.groupBy("question_id").agg(F.count(F.lit(1)).alias("options"), F.count_distinct(k).alias("different"))


@query("SELECT chunk_id, normalized_text IS NOT DISTINCT FROM CASE WHEN ends_with(s, x) THEN rtrim(left(s, length(s) - length(x))) END AS restored FROM (SELECT chunk_id, normalized_text, normalized_text || chr(10) || '[figure]' AS s, chr(10) || '[figure]' AS x FROM ch WHERE normalized_text = rtrim(normalized_text) AND normalized_text <> '')")
def supplements_removed(spark, d):
    t = tables(spark, d)("document_chunks").filter("normalized_text = rtrim(normalized_text) AND normalized_text <> ''").select("chunk_id", "normalized_text").distinct()
    x = F.lit("\n[figure]")
    return t.select("chunk_id", X.without_supplement(F.concat("normalized_text", x), x).eqNullSafe(F.col("normalized_text")).alias("restored"))


@query("SELECT pair_id, CASE WHEN ai_review_status IS NULL THEN 'REVIEW' WHEN content_hash <> 'sha256:' || sha256(array_to_string(question_ids, chr(31))) THEN 'CHANGED' ELSE 'KEEP' END AS action FROM pairs")
def review_actions(spark, d):
    """Reviews kept where the reviewed content is still the same, else asked again."""
    p = rows(spark, d, "learning_pairs", "pair_id", "ai_review_status", "content_hash", "question_ids")
    now = F.concat(F.lit("sha256:"), F.sha2(F.array_join("question_ids", "\x1f").cast("binary"), 256))
    return p.select("pair_id", F.when(F.col("ai_review_status").isNull(), "REVIEW").when(F.col("content_hash") != now, "CHANGED").otherwise("KEEP").alias("action"))


@query("SELECT coalesce(e.pair_id, a.pair_id) AS pair_id, CASE WHEN a.pair_id IS NULL THEN 'uncovered' WHEN e.pair_id IS NULL THEN 'unasked' ELSE 'different' END AS state FROM (SELECT pair_id, revision FROM pairs) e FULL JOIN (SELECT pair_id, count(*)::INT % 3 AS revision FROM qs GROUP BY pair_id) a USING (pair_id) WHERE e.revision IS DISTINCT FROM a.revision")
def review_coverage(spark, d):
    e = rows(spark, d, "learning_pairs", "pair_id", "revision").select("pair_id", "revision", F.lit(True).alias("e"))
    a = rows(spark, d, "questions", "question_id", "pair_id").groupBy("pair_id").agg((F.count(F.lit(1)) % 3).cast("int").alias("got")).withColumn("a", F.lit(True))
    j = e.join(a, "pair_id", "full_outer").filter(~F.col("revision").eqNullSafe(F.col("got")))
    return j.select("pair_id", F.when(F.col("a").isNull(), "uncovered").when(F.col("e").isNull(), "unasked").otherwise("different").alias("state"))


_SCORE = "75.0 * least(1, n_formulas / 10.0) + 7 * ln(1 + n_lines) + 4 * least(8, n_numbers) - CASE WHEN chars = 0 THEN 30 ELSE 0 END"


@query(rf"""SELECT document_id, page, score FROM (SELECT document_id, page, {_SCORE} AS score, row_number() OVER (PARTITION BY document_id ORDER BY round({_SCORE}, 6) DESC, page DESC) AS r FROM
(SELECT document_id, page_start AS page, sum(coalesce(length(normalized_text), 0)) AS chars, sum(coalesce(len(string_split(normalized_text, chr(10))), 0)) AS n_lines, sum(coalesce(length(normalized_text) - length(replace(normalized_text, '=', '')), 0)) AS n_formulas, sum(coalesce(len(regexp_extract_all(normalized_text, '[0-9]+[.][0-9]+')), 0)) AS n_numbers FROM ch GROUP BY ALL)) WHERE r = 1 AND score >= 9""")
def best_visual_page(spark, d):
    """The page of each document with the highest score, larger pages first among equals, if it is 9 at least."""
    t = F.col("normalized_text")
    c = rows(spark, d, "document_chunks", "chunk_id", "document_id", F.col("page_start").alias("page"), F.length(t).alias("c"), F.size(F.split(t, "\n")).alias("l"), (F.length(t) - F.length(F.replace(t, F.lit("=")))).alias("f"), F.size(F.regexp_extract_all(t, F.lit("[0-9]+[.][0-9]+"), F.lit(0))).alias("n"))
    z = lambda x: F.sum(F.when(F.col("c").isNotNull(), F.col(x)).otherwise(0))
    g = c.groupBy("document_id", "page").agg(z("c").alias("chars"), z("l").alias("n_lines"), z("f").alias("n_formulas"), z("n").alias("n_numbers"))
    score = 75.0 * F.least(F.lit(1.0), F.col("n_formulas") / 10.0) + 7 * F.log1p("n_lines") + 4 * F.least(F.lit(8), "n_numbers") - F.when(F.col("chars") == 0, 30).otherwise(0)
    best = g.withColumn("score", score).groupBy("document_id").agg(F.max(F.struct(F.round("score", 6).alias("r"), "page", "score")).alias("b"))
    return best.select("document_id", "b.page", "b.score").filter("score >= 9")


@query("SELECT sha256, item_no, floor(item_no / 4)::BIGINT AS batch_no FROM (SELECT sha256, row_number() OVER (ORDER BY sha256) - 1 AS item_no FROM (SELECT DISTINCT sha256 FROM ills WHERE sha256 IS NOT NULL))")
def media_batches(spark, d):
    """Different pictures in batches of four."""
    one = tables(spark, d)("illustration_assets").filter("sha256 IS NOT NULL").select("sha256").distinct()
    return C.global_number(one, ["sha256"], "item_no").withColumn("batch_no", F.floor(F.col("item_no") / 4))


@query("""SELECT event_id, user_id FROM events WHERE event_type <> 'view' OR event_id IN (
SELECT event_id FROM (WITH RECURSIVE runs AS (SELECT event_id, user_id, ts, sum((pe IS DISTINCT FROM 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pe FROM events) WHERE event_type = 'view'),
acc AS (SELECT user_id, run, min(ts) AS ts FROM runs GROUP BY ALL UNION ALL SELECT r.user_id, r.run, min(r.ts) FROM acc JOIN runs r ON r.user_id = acc.user_id AND r.run = acc.run AND r.ts >= acc.ts + INTERVAL 2 HOUR GROUP BY r.user_id, r.run, acc.ts)
SELECT min(event_id) AS event_id FROM runs JOIN acc USING (user_id, run, ts) GROUP BY user_id, run, ts))""")
def repeated_signals_dropped(spark, d):
    """Events without the views that follow an accepted view of their user within two hours, no other event between them."""
    return signals.without_repeats(tables(spark, d)("events").select("event_id", "user_id", "event_type", "ts"), "view", 7_200_000_000)


@query("SELECT document_id, page FROM (SELECT document_id, unnest(range(1, coalesce(page_count, 0)::BIGINT + 1)) AS page FROM docs WHERE page_count >= 1) WHERE (document_id, page) NOT IN (SELECT document_id, unnest(range(page_start, page_end + 1)) FROM ch WHERE page_start IS NOT NULL AND page_end IS NOT NULL)")
def missing_pages(spark, d):
    """Pages of every document that no chunk covers."""
    gaps = P.uncovered(rows(spark, d, "source_documents", "document_id", "page_count").filter("page_count >= 1"), tables(spark, d)("document_chunks"), "document_id", "page_count", "page_start", "page_end")
    return gaps.select("document_id", F.explode(F.sequence("page_from", "page_to")).alias("page"))


@query("""SELECT document_id, min(page) AS page_from, max(page) AS page_to FROM (SELECT document_id, page, page - row_number() OVER (PARTITION BY document_id ORDER BY page) AS g FROM (SELECT document_id, unnest(range(1, page_count::BIGINT + 1)) AS page FROM docs WHERE page_count >= 1)
WHERE (document_id, page) NOT IN (SELECT document_id, unnest(range(page_start, page_end + 1)) FROM ch WHERE page_start IS NOT NULL AND page_end IS NOT NULL)) GROUP BY document_id, g""")
def missing_page_ranges(spark, d):
    """The same as ranges, one row however long."""
    return P.uncovered(rows(spark, d, "source_documents", "document_id", "page_count").filter("page_count >= 1"), tables(spark, d)("document_chunks"), "document_id", "page_count", "page_start", "page_end")


@query("SELECT course_id, module_id, string_agg(title, ' | ' ORDER BY order_index, atom_id) AS outline FROM atoms WHERE title IS NOT NULL GROUP BY ALL")
def module_outlines(spark, d):
    a = rows(spark, d, "atom_plans", "course_id", "module_id", "atom_id", "order_index", "title").filter("title IS NOT NULL")
    s = F.array_sort(F.collect_list(F.struct(F.coalesce("order_index", F.lit(2**31 - 1)).alias("o"), "atom_id", "title")))
    return a.groupBy("course_id", "module_id").agg(s.alias("s")).select("course_id", "module_id", F.array_join(F.transform("s", lambda x: x["title"]), " | ").alias("outline"))


@query("SELECT module_id, sha256(string_agg(to_json({'atom_id': atom_id, 'module_id': module_id, 'order_index': order_index, 'prerequisite_ids': prerequisite_ids, 'title': title})::VARCHAR, chr(10) ORDER BY atom_id)) AS h FROM (SELECT DISTINCT module_id, atom_id, order_index, title, prerequisite_ids FROM atom_plans) GROUP BY module_id")
def module_hashes(spark, d):
    """A digest of all rows a module owns, in a fixed order."""
    a = rows(spark, d, "atom_plans", "module_id", "atom_id", "order_index", "title", "prerequisite_ids")
    j = memo.canonical_json(a)
    return a.select("module_id", "atom_id", j.alias("j")).groupBy("module_id").agg(F.array_sort(F.collect_list(F.struct("atom_id", "j"))).alias("s")).select("module_id", F.sha2(F.array_join(F.transform("s", lambda x: x["j"]), "\n").cast("binary"), 256).alias("h"))


@query("SELECT document_id, count(*) AS n, count(DISTINCT atom_id) AS atoms FROM (SELECT c.document_id, a.atom_id FROM (SELECT atom_id, unnest(list_distinct(source_ref_ids)) AS r FROM atoms) a JOIN ch c ON c.source_ref.source_ref_id = a.r) GROUP BY document_id")
def document_use(spark, d):
    """How many links and atoms rest on each document."""
    c = rows(spark, d, "document_chunks", "chunk_id", "document_id", F.col("source_ref.source_ref_id").alias("r"))
    a = rows(spark, d, "atom_plans", "atom_id", "source_ref_ids").select("atom_id", F.explode(F.array_distinct("source_ref_ids")).alias("r"))
    return a.join(c, "r").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("atom_id").alias("atoms"))


@query("SELECT lesson_id, list_transform(range(1, 1 + ceil(estimated_seconds / 20)::BIGINT), lambda i: lesson_id || '_part_' || i) AS part_ids FROM les WHERE estimated_seconds IS NOT NULL")
def part_ids(spark, d):
    t = rows(spark, d, "lessons", "lesson_id", "estimated_seconds").filter("estimated_seconds IS NOT NULL")
    return t.select("lesson_id", F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("estimated_seconds") / 20).cast("int"))), lambda i: F.concat("lesson_id", F.lit("_part_"), i)).alias("part_ids"))


@query("SELECT page_id, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(arr)] AS weekday, epoch_us(date_trunc('day', arr)) // 1000 AS midnight_ms FROM (SELECT page_id, min(ingested_at) AS arr FROM page_transcriptions GROUP BY page_id)")
def arrival_days(spark, d):
    """Weekday and midnight (UTC) of each page's first arrival."""
    p = tables(spark, d)("page_transcriptions").groupBy("page_id").agg(F.min("ingested_at").alias("at"))
    day = F.floor(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), "at") / 86_400_000_000)
    return p.select("page_id", F.element_at(F.array(*[F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]), (F.pmod(day + 3, F.lit(7)) + 1).cast("int")).alias("weekday"), (day * 86_400_000).alias("midnight_ms"))
