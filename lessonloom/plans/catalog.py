"""Queries over catalog pieces: matches by name, multisets, ledgers, pages, nested fields and overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonloom.functions.hashing import stable_id
from lessonloom.operators import extension as E
from lessonloom.operators.texts import fraction
from lessonloom.plans.content import _VIEWS, rows
from lessonloom.runtime import tables

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {_VIEWS} {sql}"
        return f

    return add


@query("SELECT a.document_id, count(DISTINCT b.document_id) AS matches FROM docs a JOIN docs b ON b.filename = a.filename OR ends_with(b.filename, ' - ' || a.filename) WHERE a.filename IS NOT NULL GROUP BY a.document_id")
def name_matches(spark, d):
    """How many documents a file name stands for, by the whole name or by what follows a " - "; one is the wish.

    A name with several such marks is found under each of its ends, so the join stays an equality.
    """
    t = rows(spark, d, "source_documents", "document_id", "filename").filter("filename IS NOT NULL").distinct()
    cuts = F.split("filename", " - ")
    ends = F.transform(F.sequence(F.lit(1), F.size(cuts)), lambda k: F.array_join(F.slice(cuts, k, F.size(cuts)), " - "))
    n = t.select("document_id", F.explode(ends).alias("filename")).groupBy("filename").agg(F.count_distinct("document_id").alias("matches"))
    return t.select("document_id", "filename").join(n, "filename").select("document_id", "matches")


@query("SELECT 'atoms' AS side, count(*) AS n FROM (SELECT unnest(source_ref_ids) FROM atoms EXCEPT ALL SELECT unnest(source_ref_ids) FROM les) UNION ALL SELECT 'lessons', count(*) FROM (SELECT unnest(source_ref_ids) FROM les EXCEPT ALL SELECT unnest(source_ref_ids) FROM atoms)")
def multiset_difference(spark, d):
    """References of atoms and lessons as multisets, both ways."""
    a = rows(spark, d, "atom_plans", "atom_id", "source_ref_ids").select(F.explode("source_ref_ids").alias("r"))
    b = rows(spark, d, "lessons", "lesson_id", "source_ref_ids").select(F.explode("source_ref_ids").alias("r"))
    n = lambda x, y, s: x.exceptAll(y).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("side"), "n")
    return n(a, b, "atoms").unionByName(n(b, a, "lessons"))


@query("SELECT user_id, sum(event_id % 1000 + event_id % 100 + floor(1.25 * (event_id % 40)) + floor(0.1 * (event_id % 70)))::BIGINT AS weighted FROM events GROUP BY user_id")
def token_ledger(spark, d):
    """Inputs and outputs in full, writes at 5/4 and reads at 1/10, each rounded down."""
    e = F.col("event_id")
    w = e % 1000 + e % 100 + F.floor(1.25 * (e % 40)) + F.floor(0.1 * (e % 70))
    return tables(spark, d)("events").groupBy("user_id").agg(F.sum(w).cast("long").alias("weighted"))


@query("SELECT document_id, count(*) AS pages, count(*) FILTER (n > 0) AS read_pages, CASE WHEN count(*) FILTER (n > 0) = count(*) THEN 'READY' WHEN count(*) FILTER (n > 0) > 0 THEN 'PARTIAL' ELSE 'BUILDING' END AS state FROM (SELECT DISTINCT page_id, document_id, coalesce(length(trim(transcription)), 0) AS n FROM page_transcriptions) GROUP BY document_id")
def audit_states(spark, d):
    p = rows(spark, d, "page_transcriptions", "page_id", "document_id", F.coalesce(F.length(F.trim("transcription")), F.lit(0)).alias("n"))
    g = p.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("n") > 0).alias("read_pages"))
    return g.withColumn("state", F.when(F.col("read_pages") == F.col("pages"), "READY").when(F.col("read_pages") > 0, "PARTIAL").otherwise("BUILDING"))


@query("SELECT p.page_id, i.illustration_id, coalesce(length(p.transcription), 0) AS chars, c.page_start <= p.page_number AND p.page_number <= c.page_end AS inside FROM (SELECT DISTINCT page_id, document_id, page_number, transcription FROM page_transcriptions) p JOIN ch c USING (document_id) JOIN ills i ON i.source_ref_id = c.source_ref.source_ref_id AND i.page_number = p.page_number")
def page_occurrences(spark, d):
    """Pictures beside the text length of their page, with the chunk's bounds checked."""
    p = rows(spark, d, "page_transcriptions", "page_id", "document_id", "page_number", F.coalesce(F.length("transcription"), F.lit(0)).alias("chars"))
    c = rows(spark, d, "document_chunks", "chunk_id", "document_id", F.col("source_ref.source_ref_id").alias("source_ref_id"), "page_start", "page_end")
    i = rows(spark, d, "illustration_assets", "illustration_id", "source_ref_id", "page_number")
    return c.join(i, "source_ref_id").join(p, ["document_id", "page_number"]).select("page_id", "illustration_id", "chars", F.col("page_number").between(F.col("page_start"), F.col("page_end")).alias("inside"))


@query("SELECT lesson_id, list_filter([title, hook, intuition] || coalesce(takeaways, []), lambda x: x IS NOT NULL)[1:3] AS first_page, greatest(1, ceil(len(list_filter([title, hook, intuition] || coalesce(takeaways, []), lambda x: x IS NOT NULL)) / 3))::INT AS pages FROM les")
def lesson_pages(spark, d):
    """Parts of a lesson in their fixed order, three to a page."""
    t = rows(spark, d, "lessons", "lesson_id", "title", "hook", "intuition", "takeaways")
    parts = F.array_compact(F.concat(F.array("title", "hook", "intuition"), F.coalesce("takeaways", F.array().cast("array<string>"))))
    return t.select("lesson_id", F.slice(parts, 1, 3).alias("first_page"), F.greatest(F.lit(1), F.ceil(F.size(parts) / 3)).cast("int").alias("pages"))


@query("SELECT illustration_id, regexp_full_match(sha256, 'sha256:[0-9a-f]{64}') AS seed_ok, 'ill_' || left(sha256(source_ref_id || chr(31) || sha256), 16) AS made_id FROM ills WHERE source_ref_id IS NOT NULL AND sha256 IS NOT NULL")
def illustration_ids(spark, d):
    i = rows(spark, d, "illustration_assets", "illustration_id", "source_ref_id", "sha256").filter("source_ref_id IS NOT NULL AND sha256 IS NOT NULL")
    return i.select("illustration_id", F.col("sha256").rlike("^sha256:[0-9a-f]{64}$").alias("seed_ok"), stable_id("ill", F.col("source_ref_id"), F.col("sha256")).alias("made_id"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AS finite, list_max(embedding)::DOUBLE AS top FROM embeddings")
def finite_vectors(spark, d):
    bad = F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return tables(spark, d)("embeddings").select("vec_id", (~bad).alias("finite"), F.array_max("embedding").cast("double").alias("top"))


@query()
def strict_payloads(spark, d):
    return tables(spark, d)("events").select("event_id", E.strict_json(F.col("props")).alias("problem"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS kind, CASE WHEN event_type NOT IN ('view', 'click') THEN 'UNKNOWN_KIND' WHEN event_type = 'click' AND value <= 50 THEN 'BAD_FIELDS' END AS problem FROM events")
def tagged_records(spark, d):
    """JSON records with a tag: known kinds, fields of their types."""
    doc = F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("n"), F.when(F.col("value") > 50, F.col("value")).alias("x")))
    e = tables(spark, d)("events").select("event_id", E.decoded(doc, "kind", {"view": {"n": "bigint"}, "click": {"n": "bigint", "x": "double"}}).alias("r"))
    return e.select("event_id", F.when(F.col("r.kind").isin("view", "click"), F.col("r.kind")).alias("kind"), "r.problem")


@query("SELECT lesson_id, list_filter([CASE WHEN l.title IS DISTINCT FROM a.title THEN 'title' END, CASE WHEN l.source_ref_ids IS DISTINCT FROM a.source_ref_ids THEN 'source_ref_ids' END], lambda x: x IS NOT NULL) AS changed FROM les l JOIN atoms a USING (atom_id)")
def changed_fields(spark, d):
    a = rows(spark, d, "atom_plans", "atom_id", F.col("title").alias("t"), F.col("source_ref_ids").alias("s"))
    j = rows(spark, d, "lessons", "lesson_id", "atom_id", "title", "source_ref_ids").join(a, "atom_id")
    return j.select("lesson_id", E.changed_fields({"title": F.col("title"), "source_ref_ids": F.col("source_ref_ids")}, {"title": F.col("t"), "source_ref_ids": F.col("s")}).alias("changed"))


@query("SELECT question_id, list_transform(options, lambda o: [o.id, upper(o.text)]) AS restored FROM qs")
def nested_edit(spark, d):
    """One field of nested records rewritten, the others as they were."""
    q = rows(spark, d, "questions", "question_id", "options")
    return q.select("question_id", F.transform(F.transform("options", lambda o: o.withField("text", F.upper(o["text"]))), lambda o: F.array(o["id"], o["text"])).alias("restored"))


@query("SELECT atom_id, lesson_id, coalesce(pos, 0)::INT AS at FROM (SELECT a.atom_id, l.lesson_id, greatest(0, coalesce(list_position(l.source_ref_ids, a.source_ref_ids[1]), 0) - 1) AS pos FROM atoms a JOIN les l USING (atom_id))".replace(" AS at", " AS place"))
def place_in_list(spark, d):
    """The place of an id in a list, 0 if it isn't there."""
    a = rows(spark, d, "atom_plans", "atom_id", F.get("source_ref_ids", F.lit(0)).alias("r"))
    j = rows(spark, d, "lessons", "lesson_id", "atom_id", "source_ref_ids").join(a, "atom_id")
    return j.select("atom_id", "lesson_id", F.greatest(F.lit(0), F.coalesce(F.array_position("source_ref_ids", F.col("r")), F.lit(0)) - 1).cast("int").alias("place"))


@query("SELECT atom_id, page_start, n FROM (SELECT a.atom_id, c.document_id, c.page_start, count(*) AS n FROM (SELECT atom_id, unnest(list_distinct(source_ref_ids)) AS r FROM atoms) a JOIN ch c ON c.source_ref.source_ref_id = a.r GROUP BY ALL) WHERE n > 1")
def page_atomicity(spark, d):
    """Atoms that hold several chunks of one page."""
    a = rows(spark, d, "atom_plans", "atom_id", "source_ref_ids").select("atom_id", F.explode(F.array_distinct("source_ref_ids")).alias("r"))
    c = rows(spark, d, "document_chunks", "chunk_id", "document_id", "page_start", F.col("source_ref.source_ref_id").alias("r"))
    return a.join(c, "r").groupBy("atom_id", "document_id", "page_start").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("atom_id", "page_start", "n")


@query("SELECT document_id, page, origin FROM (SELECT document_id, page_start AS page, 'text' AS origin FROM ch WHERE (document_id, page_start) NOT IN (SELECT document_id, page_number FROM page_transcriptions WHERE content_kind = 'NONTECHNICAL' AND document_id IS NOT NULL AND page_number IS NOT NULL) UNION SELECT document_id, page_number, 'scan' FROM page_transcriptions WHERE content_kind IS DISTINCT FROM 'NONTECHNICAL' AND trim(transcription) <> '')")
def corpus_with_scans(spark, d):
    """Pages with scans added and excluded pages taken out."""
    t = tables(spark, d)
    p = t("page_transcriptions").select("document_id", F.col("page_number").alias("page"), "content_kind", "transcription")
    out = p.filter("content_kind = 'NONTECHNICAL'").select("document_id", "page").distinct()
    text = t("document_chunks").select("document_id", F.col("page_start").alias("page"), F.lit("text").alias("origin")).distinct().join(out, ["document_id", "page"], "left_anti")
    scans = p.filter("(content_kind IS NULL OR content_kind <> 'NONTECHNICAL') AND trim(transcription) <> ''").select("document_id", "page", F.lit("scan").alias("origin"))
    return text.unionByName(scans).distinct()


@query("SELECT document_id, part, min(page_start) AS page_lo, max(page_end) AS page_hi, count(*) AS chunks, sum(coalesce(length(normalized_text), 0))::BIGINT AS chars FROM (SELECT *, floor((page_start - 1) / 8)::BIGINT AS part FROM ch WHERE page_start IS NOT NULL) GROUP BY ALL")
def document_parts(spark, d):
    """Chunks of each document in parts of eight pages; empty parts don't exist."""
    c = rows(spark, d, "document_chunks", "chunk_id", "document_id", "page_start", "page_end", F.coalesce(F.length("normalized_text"), F.lit(0)).alias("n")).filter("page_start IS NOT NULL")
    return c.groupBy("document_id", F.floor((F.col("page_start") - 1) / 8).alias("part")).agg(F.min("page_start").alias("page_lo"), F.max("page_end").alias("page_hi"), F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("chars"))


@query("SELECT event_id, greatest(0, coalesce(CASE WHEN value > 50 THEN epoch_us(ts) // 1000 END, 1704067200000) - (epoch_us(ts) // 1000 - 500)) AS latency_ms, least(5, greatest(0, value::INT)) AS clamped FROM events WHERE value IS NOT NULL".replace("value::INT", "floor(value)::INT"))
def latencies(spark, d):
    """Elapsed times that can't be negative, and clamped settings."""
    ms = F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), "ts")
    seen = F.coalesce(F.when(F.col("value") > 50, ms), F.lit(1_704_067_200_000))
    return tables(spark, d)("events").filter("value IS NOT NULL").select("event_id", F.greatest(F.lit(0), seen - (ms - 500)).alias("latency_ms"), F.least(F.lit(5), F.greatest(F.lit(0), F.floor("value").cast("int"))).alias("clamped"))


@query("SELECT l.lesson_id, CASE WHEN p.pair_id IS NOT NULL THEN l.title END AS title FROM les l LEFT JOIN (SELECT DISTINCT pair_id FROM pairs WHERE ai_review_status = 'AI_APPROVED') p USING (pair_id)")
def masked_titles(spark, d):
    t = rows(spark, d, "lessons", "lesson_id", "pair_id", "title")
    ok = tables(spark, d)("learning_pairs").filter("ai_review_status = 'AI_APPROVED'").select("pair_id")
    return E.masked(t, ok, "pair_id", "title", True).select("lesson_id", "title")


@query(r"SELECT lesson_id, CASE WHEN n > 2 THEN 'READY' ELSE 'FAILED' END AS status, '{\"n\": ' || n || '}' AS output_json, CASE WHEN n > 2 THEN NULL ELSE 'TOO_SHORT' END AS error FROM (SELECT DISTINCT lesson_id, len(regexp_extract_all(coalesce(title, ''), '\S+')) AS n, title, hook FROM lessons)".replace(chr(92) + chr(34), chr(34)))
def external_calls(spark, d):
    """An outside call per lesson with its output checked; here an offline one."""
    t = rows(spark, d, "lessons", "lesson_id", "title", "hook")
    return E.external(t, "lesson_id", ["title", "hook"], lambda r: {"n": len((r["title"] or "").split())}, lambda o: None if o["n"] > 2 else "TOO_SHORT")


@query()
def formula_fractions(spark, d):
    t = tables(spark, d)("lessons").select("lesson_id", F.posexplode("formula_blocks").alias("pos", "b")).select("lesson_id", "pos", "b.latex").distinct()
    return t.select("lesson_id", "pos", fraction(F.col("latex")).alias("fraction"))
