"""Queries over joins with the catalogue, orders, first occurrences, addresses, time zones and nested values."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.operators import content as C
from lessonloom.operators import study as S
from lessonloom.operators.chunking import display_pages
from lessonloom.plans import content, study
from lessonloom.plans.content import rows
from lessonloom.runtime import tables

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            views = study._VIEWS.replace("les AS (", "read AS (", 1) + "," + content._VIEWS
            SQL[f.__name__] = f"WITH {views} {sql}"
        return f

    return add


def _events(spark, d):
    return tables(spark, d)("events")


@query("SELECT 'a' || c_custkey AS atom_id, coalesce(status, 'NEW') AS status, coalesce(mastery, 0) AS mastery, coalesce(due_at, 0) AS due_at, last_studied_at FROM customer LEFT JOIN prog ON prog.atom_id = 'a' || c_custkey")
def catalog_progress(spark, d):
    """Every item of a catalogue with its progress, or that of one never studied."""
    c = tables(spark, d)("customer").select(F.concat(F.lit("a"), "c_custkey").alias("atom_id"))
    p = S.progress(_events(spark, d)).select("atom_id", "status", "mastery", "due_at", "last_studied_at")
    return c.join(p, "atom_id", "left").select("atom_id", F.coalesce("status", F.lit("NEW")).alias("status"), F.coalesce("mastery", F.lit(0.0)).alias("mastery"), F.coalesce("due_at", F.lit(0)).alias("due_at"), "last_studied_at")


@query("SELECT 'mistakes' AS kind, question_id AS id FROM mis WHERE atom_id IN (SELECT 'a' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'progress', atom_id FROM prog WHERE atom_id IN (SELECT 'a' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def known_records(spark, d):
    """Mistakes and progress of the items that the catalogue holds."""
    known = tables(spark, d)("customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("a"), "c_custkey").alias("atom_id"))
    m = S.mistakes(_events(spark, d)).join(known, "atom_id", "left_semi").select(F.lit("mistakes").alias("kind"), F.col("question_id").alias("id"))
    return m.unionByName(S.progress(_events(spark, d)).join(known, "atom_id", "left_semi").select(F.lit("progress").alias("kind"), F.col("atom_id").alias("id")))


@query("SELECT *, row_number() OVER (ORDER BY atom_id) - 1 AS place FROM prog")
def progress_ordered(spark, d):
    """All progress with its place in the order of ids, numbered without a window over the whole table."""
    return C.global_number(S.progress(_events(spark, d)), ["atom_id"], "place")


@query("SELECT question_id, row_number() OVER (ORDER BY due_at, last_seen_at DESC, question_id) - 1 AS place FROM mis")
def mistakes_ordered(spark, d):
    """Mistakes in the order in which they fall due, the last seen first among equals."""
    m = S.mistakes(_events(spark, d)).withColumn("seen", -F.col("last_seen_at"))
    return C.global_number(m, ["due_at", "seen", "question_id"], "place").select("question_id", "place")


@query("SELECT question_id, b.r AS review_box, b.d AS due_at, passed, spaced FROM (SELECT question_id, passed, spaced, CASE WHEN passed AND spaced THEN {'r': least(3, review_box + 1), 'd': last_seen_at + [3, 7, 14, 30][least(3, review_box + 1) + 1] * 86400000::BIGINT} WHEN passed THEN {'r': review_box, 'd': last_seen_at + [3, 7, 14, 30][review_box + 1] * 86400000::BIGINT} WHEN spaced THEN {'r': 0::BIGINT, 'd': last_seen_at} ELSE {'r': 0::BIGINT, 'd': last_seen_at + 3 * 86400000::BIGINT} END AS b FROM mis, (VALUES (true, true), (true, false), (false, true), (false, false)) v(passed, spaced))")
def mistake_branches(spark, d):
    """The next review of every mistake for each outcome: a passed spaced review climbs, another pass keeps its box, a failure starts anew."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("passed"), F.lit(s).alias("spaced")) for p in (True, False) for s in (True, False)]))
    m = S.mistakes(_events(spark, d)).select("question_id", F.col("review_box").cast("long").alias("box"), "last_seen_at", each.alias("o")).select("question_id", "box", "last_seen_at", "o.*")
    days = lambda b: F.element_at(F.array(*[F.lit(x) for x in S.MISTAKE_DAYS]), (b + 1).cast("int")).cast("long") * F.lit(S.DAY)
    up = F.least(F.lit(3).cast("long"), F.col("box") + 1)
    box = F.when(F.col("passed") & F.col("spaced"), up).when(F.col("passed"), F.col("box")).otherwise(F.lit(0).cast("long"))
    due = F.col("last_seen_at") + F.when(F.col("passed"), days(box)).when(F.col("spaced"), F.lit(0).cast("long")).otherwise(F.lit(3 * S.DAY).cast("long"))
    return m.select("question_id", box.alias("review_box"), due.alias("due_at"), "passed", "spaced")


@query("SELECT sha256, arg_min(mime_type, k) AS mime_type, arg_min(regexp_extract(asset_member, '\\.([A-Za-z0-9]+)$', 1), k) AS suffix, count(DISTINCT illustration_id) AS occurrences FROM (SELECT sha256, mime_type, coalesce(asset_member, '') AS asset_member, illustration_id, (min(ingested_at) OVER (PARTITION BY illustration_id), illustration_id) AS k FROM illustration_assets WHERE sha256 IS NOT NULL) GROUP BY sha256")
def media_first(spark, d):
    """Each different picture once, with type and suffix as they first arrived."""
    i = tables(spark, d)("illustration_assets").filter("sha256 IS NOT NULL").groupBy("illustration_id", "sha256", "mime_type", "asset_member").agg(F.min("ingested_at").alias("at"))
    first = i.groupBy("sha256").agg(F.min_by(F.struct("mime_type", F.regexp_extract(F.coalesce("asset_member", F.lit("")), r"\.([A-Za-z0-9]+)$", 1).alias("suffix")), F.struct("at", "illustration_id")).alias("f"), F.count_distinct("illustration_id").alias("occurrences"))
    return first.select("sha256", "f.mime_type", "f.suffix", "occurrences")


@query("SELECT count(DISTINCT i.illustration_id) FILTER (u.r IS NULL) AS unreferenced, count(DISTINCT i.illustration_id) AS pictures, count(DISTINCT c.document_id) AS documents FROM ills i LEFT JOIN (SELECT DISTINCT unnest(illustration_source_ref_ids) AS r FROM lessons) u ON u.r = i.source_ref_id LEFT JOIN ch c ON c.source_ref.source_ref_id = i.source_ref_id")
def media_use(spark, d):
    """Pictures that no lesson shows, and documents with pictures."""
    i = rows(spark, d, "illustration_assets", "illustration_id", "source_ref_id")
    used = tables(spark, d)("lessons").select(F.explode("illustration_source_ref_ids").alias("source_ref_id")).distinct().withColumn("used", F.lit(True))
    c = rows(spark, d, "document_chunks", F.col("source_ref.source_ref_id").alias("source_ref_id"), "document_id")
    j = i.join(used, "source_ref_id", "left").join(c, "source_ref_id", "left")
    return j.agg(F.count_distinct(F.when(F.col("used").isNull(), F.col("illustration_id"))).alias("unreferenced"), F.count_distinct("illustration_id").alias("pictures"), F.count_distinct("document_id").alias("documents"))


@query("SELECT document_id, canonical FROM (SELECT DISTINCT document_id, sha256 FROM source_documents WHERE sha256 IS NOT NULL) JOIN (SELECT sha256, arg_min(document_id, (arr, document_id)) AS canonical FROM (SELECT sha256, document_id, min(ingested_at) AS arr FROM source_documents WHERE sha256 IS NOT NULL GROUP BY ALL) GROUP BY sha256) USING (sha256)")
def document_canonicals(spark, d):
    """Each document with the first that arrived with its bytes."""
    t = tables(spark, d)("source_documents").filter("sha256 IS NOT NULL").groupBy("sha256", "document_id").agg(F.min("ingested_at").alias("at"))
    first = t.groupBy("sha256").agg(F.min_by("document_id", F.struct("at", "document_id")).alias("canonical"))
    return t.select("sha256", "document_id").join(first, "sha256").select("document_id", "canonical")


@query("SELECT lesson_id, title, row_number() OVER (ORDER BY order_index NULLS LAST, lesson_id) - 1 AS place FROM (SELECT DISTINCT lesson_id, l.title, a.order_index FROM les l JOIN atoms a USING (atom_id) WHERE contains(replace(strip_accents(lower(l.title)), 'đ', 'd'), 'hoc'))")
def lesson_search_ordered(spark, d):
    """Lessons found by their title in the order of the course, those without a place last."""
    a = rows(spark, d, "atom_plans", "atom_id", "order_index")
    found = C.search(rows(spark, d, "lessons", "lesson_id", "atom_id", "title"), ["title"], "Học").join(a, "atom_id").select("lesson_id", "title", F.coalesce("order_index", F.lit(2**31 - 1)).alias("o")).distinct()
    return C.global_number(found, ["o", "lesson_id"], "place").select("lesson_id", "title", "place")


@query("SELECT lesson_id, source_ref_id, row_number() OVER w AS segment, count(*) OVER (PARTITION BY lesson_id) AS segments FROM (SELECT l.lesson_id, l.r AS source_ref_id, l.pos, c.page_start, c.chunk_id FROM (SELECT lesson_id, r, min(pos) AS pos FROM (SELECT lesson_id, unnest(source_ref_ids) AS r, generate_subscripts(source_ref_ids, 1) AS pos FROM les) GROUP BY ALL) l JOIN (SELECT DISTINCT chunk_id, source_ref.source_ref_id AS r, page_start FROM ch) c USING (r)) WINDOW w AS (PARTITION BY lesson_id ORDER BY pos, page_start, chunk_id)")
def lesson_excerpts(spark, d):
    """A lesson's excerpts in the order in which it first names them, then by page, numbered; a lesson names few."""
    named = rows(spark, d, "lessons", "lesson_id", "source_ref_ids").select("lesson_id", F.posexplode("source_ref_ids").alias("pos", "source_ref_id")).groupBy("lesson_id", "source_ref_id").agg(F.min("pos").alias("pos"))
    c = rows(spark, d, "document_chunks", "chunk_id", F.col("source_ref.source_ref_id").alias("source_ref_id"), "page_start")
    j = C.running_number(named.join(c, "source_ref_id"), ["lesson_id"], ["pos", "page_start", "chunk_id"], "n")
    n = j.groupBy("lesson_id").agg(F.count(F.lit(1)).alias("segments"))
    return j.join(n, "lesson_id").select("lesson_id", "source_ref_id", (F.col("n") + 1).alias("segment"), "segments")


@query("SELECT DISTINCT l.document_id, l.page, l.longest, a.atom_id FROM (SELECT document_id, page_start AS page, arg_max(chunk_id, (coalesce(length(normalized_text), 0), chunk_id)) AS longest FROM ch GROUP BY ALL) l JOIN (SELECT DISTINCT chunk_id, source_ref.source_ref_id AS r FROM ch) c ON c.chunk_id = l.longest JOIN (SELECT atom_id, unnest(source_ref_ids) AS r FROM atoms) a ON a.r = c.r")
def page_owners(spark, d):
    """The atoms that own the longest chunk of each page: where a figure of that page belongs."""
    c = rows(spark, d, "document_chunks", F.col("chunk_id").alias("longest"), F.col("source_ref.source_ref_id").alias("r"))
    a = rows(spark, d, "atom_plans", "atom_id", "source_ref_ids").select("atom_id", F.explode("source_ref_ids").alias("r"))
    return content.longest_chunk(spark, d).join(c, "longest").join(a, "r").select("document_id", "page", "longest", "atom_id").distinct()


@query("SELECT lesson_id, CASE WHEN contains(lower(title), 'gradient') THEN 'EXERCISE' WHEN contains(lower(title), 'dropout') THEN 'QUIZ' WHEN contains(lower(title), 'mô hình') THEN 'PROJECT' ELSE 'ACTIVITY' END AS kind FROM (SELECT DISTINCT lesson_id, title FROM les WHERE title IS NOT NULL)")
def activity_kinds(spark, d):
    """The kind of an activity by the first keyword of a list that its title holds."""
    t = rows(spark, d, "lessons", "lesson_id", "title").filter("title IS NOT NULL")
    return t.select("lesson_id", C.by_rules(F.lower("title"), [("gradient", "EXERCISE"), ("dropout", "QUIZ"), ("mô hình", "PROJECT")], "ACTIVITY").alias("kind"))


_LINK = "['https://', 'http://', 'ftp://', 'https://u:p@', 'https:///', 'https://a b.'][1 + document_no % 6] || source_site || '.example/x'"


@query(f"SELECT document_id, CASE WHEN regexp_matches(url, '\\s') THEN 'BLANK' WHEN NOT regexp_matches(url, '^https?://') THEN 'SCHEME' WHEN NOT regexp_matches(url, '^https?://[^/?#]') THEN 'HOST' WHEN regexp_matches(url, '^https?://[^/?#]*@') THEN 'CREDENTIALS' END AS problem FROM (SELECT document_id, {_LINK} AS url FROM (SELECT DISTINCT document_id, source_site, ascii(right(document_id, 1)) AS document_no FROM docs WHERE source_site IS NOT NULL))")
def link_problems(spark, d):
    """Why an address may not be followed: blanks, another scheme than http, no host, credentials."""
    t = rows(spark, d, "source_documents", "document_id", "source_site").filter("source_site IS NOT NULL")
    heads = F.array(*[F.lit(x) for x in ("https://", "http://", "ftp://", "https://u:p@", "https:///", "https://a b.")])
    url = F.concat(F.element_at(heads, (F.ascii(F.right("document_id", F.lit(1))) % 6 + 1)), "source_site", F.lit(".example/x"))
    return t.select("document_id", C.link_problem(url).alias("problem"))


@query("SELECT question_id, stem, list_transform(options, lambda o: o.text) AS options FROM (SELECT DISTINCT question_id, stem, options FROM qs)")
def redacted_questions(spark, d):
    """Questions as a reviewer sees them: neither the right option nor why."""
    return rows(spark, d, "questions", "question_id", "stem", "options").select("question_id", "stem", F.transform("options", lambda o: o["text"]).alias("options"))


@query("SELECT event_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS day, epoch_us(date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York') AT TIME ZONE 'America/New_York') // 1000 AS midnight_ms FROM events")
def zone_days(spark, d):
    """The day of each event in a zone with summer time, and when that day began."""
    from lessonloom.streaming.signals import utc

    ms = F.unix_millis(utc(F.col("ts")))
    return _events(spark, d).select("event_id", S.zone_day(ms, "America/New_York").alias("day"), S.zone_midnight(ms, "America/New_York").alias("midnight_ms"))


@query()
def lesson_page_texts(spark, d):
    """All pages of a lesson: its parts in their fixed order, three to a page, each part in display pieces without loss."""
    t = rows(spark, d, "lessons", "lesson_id", "title", "hook", "intuition", "takeaways")
    parts = F.array_compact(F.concat(F.array("title", "hook", "intuition"), F.coalesce("takeaways", F.array().cast("array<string>"))))
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("parts") / 3).cast("int") - 1)), lambda k: F.array(F.slice("parts", k * 3 + 1, 3))))
    cut = F.udf(lambda ps: [[x for p in page for x in display_pages(p)] for page in ps or []], T.ArrayType(T.ArrayType(T.StringType())), useArrow=True)
    return t.withColumn("parts", parts).select("lesson_id", F.posexplode(cut(pieces)).alias("page", "pieces"))


@query()
def nested_changes(spark, d):
    """Where a lesson's example and its plan's lists differ, by path."""
    t = rows(spark, d, "lessons", "lesson_id", "atom_id", "prerequisite_ids", "source_ref_ids")
    a = rows(spark, d, "atom_plans", "atom_id", F.col("prerequisite_ids").alias("p"), F.col("source_ref_ids").alias("s"))
    j = t.join(a, "atom_id")
    pair = lambda x, y: F.to_json(F.struct(F.col(x).alias("prerequisite_ids"), F.col(y).alias("source_ref_ids")), {"ignoreNullFields": "false"})
    return j.select("lesson_id", nested_paths(pair("prerequisite_ids", "source_ref_ids"), pair("p", "s")).alias("paths"))


def changed_paths(a, b, at: str = "$") -> list[str]:
    """Paths at which two values differ; where lengths or types do, the path of the whole."""
    if isinstance(a, dict) and isinstance(b, dict):
        return [p for k in sorted(a.keys() | b.keys()) for p in ([f"{at}.{k}"] if (k in a) != (k in b) else changed_paths(a[k], b[k], f"{at}.{k}"))]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [p for k, (x, y) in enumerate(zip(a, b)) for p in changed_paths(x, y, f"{at}[{k}]")]
    return [] if a == b and type(a) is type(b) else [at]


def nested_paths(a, b):
    return F.udf(lambda x, y: changed_paths(json.loads(x or "null"), json.loads(y or "null")), T.ArrayType(T.StringType()), useArrow=True)(a, b)


def key_paths(v, wanted: frozenset[str], at: str = "$") -> list[str]:
    """Paths of the wanted keys at any depth."""
    if isinstance(v, dict):
        return [p for k in sorted(v) for p in [*([f"{at}.{k}"] if k.lower() in wanted else []), *key_paths(v[k], wanted, f"{at}.{k}")]]
    return [p for k, x in enumerate(v) for p in key_paths(x, wanted, f"{at}[{k}]")] if isinstance(v, list) else []


@query("SELECT event_id, CASE WHEN json_keys(props) = ['k'] THEN ['$.outer.k', '$.list[0].k', '$.list[1].k'] ELSE [] END AS paths FROM events WHERE props IS NOT NULL")
def forbidden_paths(spark, d):
    """Forbidden keys of a nested record with their paths."""
    doc = F.concat(F.lit('{"list": ['), "props", F.lit(", "), "props", F.lit('], "outer": '), "props", F.lit("}"))
    scan = F.udf(lambda x: sorted(key_paths(json.loads(x), frozenset({"k"})), key=lambda p: ("outer" not in p, p)), T.ArrayType(T.StringType()), useArrow=True)
    return _events(spark, d).filter("props IS NOT NULL").select("event_id", scan(doc).alias("paths"))
