"""Queries over chunking, numeric kernels, memoised steps, manifests and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lessonloom.functions.text import nfkc
from lessonloom.operators import chunking, labs, memo
from lessonloom.operators import study as S
from lessonloom.runtime import tables
from lessonloom.streaming import signals

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def document_chunks_made(spark, d):
    """Chunks of all documents, with identities and digests."""
    pages = tables(spark, d)("documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), "text")
    return chunking.chunks(pages).select("document_id", "section_no", "part_no", "chunk_id", "source_ref_id", "heading_path", "text_hash")


@query(r"SELECT doc_id, sha256(text) AS joined, length(text) <= 360 AS one_page, true AS fits FROM documents WHERE text IS NOT NULL AND text <> '' AND NOT regexp_matches(text, '[\x{10000}-\x{10FFFF}]')")
def display_pages(spark, d):
    """Display pages joined again are the text; each has 360 units at most, and a text of that size is one page."""
    t = tables(spark, d)("documents").filter("text <> ''").filter(~F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]")).select("doc_id", chunking.paged(F.col("text")).alias("pages"))
    return t.select("doc_id", F.sha2(F.array_join("pages", "").cast("binary"), 256).alias("joined"), (F.size("pages") == 1).alias("one_page"), F.forall("pages", lambda p: F.length(p) <= 360).alias("fits"))


@query()
def first_clauses(spark, d):
    t = tables(spark, d)("lessons").select("lesson_id", "learning_objective").distinct()
    return t.select("lesson_id", chunking.clause(F.col("learning_objective")).alias("clause"))


@query()
def compat_titles(spark, d):
    """Titles in compatibility form."""
    return tables(spark, d)("lessons").select("lesson_id", "title").distinct().select("lesson_id", nfkc(F.col("title")).alias("title"))


@query("SELECT event_id, value - 0.1::DOUBLE * (value / 10) AS stepped, greatest(0, value - 50) AS relu, 1 / (1 + exp(-(value - 50) / 10)) AS sigmoid, tanh((value - 50) / 100) AS tanh FROM events")
def lab_steps(spark, d):
    v = F.col("value")
    return tables(spark, d)("events").select("event_id", labs.gradient_step(v, v / 10, F.lit(0.1)).alias("stepped"), labs.activation("RELU", v - 50).alias("relu"), labs.activation("SIGMOID", (v - 50) / 10).alias("sigmoid"), labs.activation("TANH", (v - 50) / 100).alias("tanh"))


@query("SELECT vec_id, list_transform(range(0, 7), lambda r: list_transform(range(0, 7), lambda c: embedding[r * 8 + c + 1]::DOUBLE * 1.0 + embedding[r * 8 + c + 2]::DOUBLE * 0.5 + embedding[(r + 1) * 8 + c + 1]::DOUBLE * -0.5 + embedding[(r + 1) * 8 + c + 2]::DOUBLE * -1.0)) AS conv FROM embeddings")
def lab_convolution(spark, d):
    """Each vector as 8 by 8, correlated with a 2 by 2 kernel."""
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.get("embedding", r * 8 + c).cast("double")))
    return tables(spark, d)("embeddings").select("vec_id", m.alias("m")).select("vec_id", labs.convolve(F.col("m"), [[1.0, 0.5], [-0.5, -1.0]]).alias("conv"))


@query("SELECT vec_id, list_filter(range(2, 33), lambda i: embedding[i] < embedding[i - 1] AND embedding[32 + i] > embedding[32 + i - 1])[1]::INT AS epoch FROM embeddings")
def lab_overfit(spark, d):
    """The halves of each vector as training and validation losses."""
    e = tables(spark, d)("embeddings")
    return e.select("vec_id", labs.first_overfit(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("epoch"))


@query("""WITH p AS (SELECT a.reading_level AS x, b.reading_level AS y FROM reading_labels a JOIN reading_labels b ON a.doc_id = b.doc_id AND a.annotator = 'a1' AND b.annotator = 'a2'),
c AS (SELECT x AS k FROM p UNION SELECT y FROM p), r AS (SELECT k, count(p.x) AS n, count(*) FILTER (p.x = p.y) AS hit FROM c LEFT JOIN p ON p.x = c.k GROUP BY k) SELECT sum(hit) / sum(n) AS accuracy, avg(CASE WHEN n > 0 THEN hit / n ELSE 0 END) AS macro_recall FROM r""")
def lab_confusion(spark, d):
    """Agreement of two annotators as a confusion matrix."""
    r = tables(spark, d)("reading_labels")
    a = r.filter("annotator = 'a1'").select("doc_id", F.col("reading_level").alias("x"))
    b = r.filter("annotator = 'a2'").select("doc_id", F.col("reading_level").alias("y"))
    return labs.confusion(a.join(b, "doc_id"), "x", "y")


@query("SELECT lesson_id FROM (SELECT DISTINCT lesson_id, sha256('draft' || chr(31) || 'v1' || chr(31) || coalesce('=' || lesson_id, '~') || chr(31) || coalesce('=' || title, '~')) AS k, estimated_seconds FROM lessons) WHERE estimated_seconds > 60")
def memo_missing(spark, d):
    """Lessons whose step has to be computed: those up to a minute count as cached."""
    t = tables(spark, d)("lessons").select("lesson_id", "title", "estimated_seconds").distinct()
    keyed = t.withColumn("cache_key", memo.step_key("draft", "v1", F.col("lesson_id"), F.col("title")))
    cache = keyed.filter("estimated_seconds <= 60").select("cache_key", F.lit("READY").alias("status"))
    return memo.missing(keyed.filter("estimated_seconds IS NOT NULL"), cache).select("lesson_id")


@query()
def manifest_of_tables(spark, d):
    t = tables(spark, d)
    return memo.manifest({n: t(n) for n in ("atom_plans", "learning_pairs", "mixture_targets", "source_documents")})


@query()
def signal_states(spark, d):
    """The last state of each user, replayed as a batch."""
    return signals.replayed(tables(spark, d)("events"))


@query()
def signal_states_streamed(spark, d):
    """The same states from the stream, the last row of each user."""
    out = signals.drained(signals.streamed(signals.event_stream(spark, f"{d}/events.parquet")), mode="update", spark=spark)
    return S.latest(out, ["user_id"], [F.col("batch_id"), F.col("revision")]).drop("batch_id")


@query("SELECT (epoch_us(date_trunc('day', ts)) // 1000)::BIGINT AS start_ms, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return signals.windowed(tables(spark, d)("events"))


@query("SELECT (epoch_us(date_trunc('day', ts)) // 1000)::BIGINT AS start_ms, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def windowed_counts_streamed(spark, d):
    """Every window's last update from the stream is the batch result."""
    out = signals.drained(signals.windowed(signals.event_stream(spark, f"{d}/events.parquet")), mode="update", spark=spark)
    return S.latest(out, ["start_ms", "event_type"], [F.col("batch_id")]).drop("batch_id")


@query("SELECT count(DISTINCT event_id) AS events FROM events")
def deduplicated_stream(spark, d):
    e = signals.event_stream(spark, f"{d}/events.parquet")
    return signals.drained(signals.deduplicated(e, ["event_id"]).drop("at"), spark=spark).agg(F.count(F.lit(1)).alias("events"))
