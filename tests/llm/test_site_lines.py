import unicodedata

from pyspark.sql import functions as F

from lessonloom.llm import site_lines as L

SCHEMA = "chunk_id string, document_id string, source_site string, normalized_text string, source string, k1 int"


def brute(rows, least=5, share=50):
    docs, lines = {}, {}
    for c, d, s, t, *_ in rows:
        if s is None or d is None:
            continue
        docs.setdefault(s, set()).add(d)
        for n, line in enumerate((t or "").split("\n") if t is not None and c is not None else [], 1):
            line = unicodedata.normalize("NFC", line)
            runs = "".join(x if x.isalpha() else " " for x in line).split()
            if len(runs) >= 3:
                lines.setdefault((s, "".join(runs).lower()), []).append((d, c, n))
    return {(c, n) for (s, _), at in lines.items() if len({d for d, *_ in at}) >= least and len({d for d, *_ in at}) * share >= len(docs[s]) for _, c, n in at}


def run(spark, rows, **k):
    return L.repeated_lines(spark.createDataFrame(rows, SCHEMA), **k)


def test_equals_brute_force_with_nulls_variants_and_repeats(spark):
    nfd = unicodedata.normalize("NFD", "Bản quyền thuộc Trường Mới 12")
    rows = [(f"c{i}", f"d{i}", "s", f"Bản quyền thuộc trường mới, {i}!\n\nown line {i} of text{i}\nshare this now", "x", 1) for i in range(4)]
    rows += [("c4", "d4", "s", nfd + "\nshare this now please", None, None), ("c5", "d5", "s", "share this now\nshare this now", None, 2), ("c6", "d6", "s", None, None, 2), ("c7", "d7", "s", "", None, 2), ("c8", None, "s", "share this now", None, 2), ("c9", "d9", None, "share this now", None, 2), (None, "d10", "s", "share this now", None, 2), ("ca", "d11", "other", "share this now", None, 2)]
    rows += [rows[0]]
    want = brute(rows)
    got = [(r.rec, r.line_no) for r in run(spark, rows).collect()]
    assert set(got) == want and len(got) == len(want) and want
    assert run(spark, [r for r in rows if False]).count() == 0


def test_share_of_a_large_source_and_dense_bitmaps(spark):
    docs = spark.range(3000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.concat(F.lit("d"), "id").alias("document_id"), F.lit("s").alias("source_site"), F.when(F.col("id") % 2 == 0, "everyone prints this line").when(F.col("id") < 50, "only a few print this").otherwise("nothing").alias("normalized_text"))
    got = L.repeated_lines(docs)
    assert got.count() == 1500  # 25 of 3000 documents are under one in fifty


def test_cleaning(spark):
    rows = [(f"c{i}", f"d{i}", "s", f"keep\nread more stories here\nend {i}", None, None) for i in range(6)] + [("z", "dz", "s", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.chunk_id: r for r in L.without_lines(df, L.repeated_lines(df)).collect()}
    assert out["c3"].cleaned_text == "keep\nend 3" and out["c3"].removed_lines == 1 and out["z"].cleaned_text is None


def test_bitmaps_of_variants_are_united(spark):
    at = lambda o: {"word": F.floor(o / L.WORD).cast("int"), "bit": (o % L.WORD).cast("int")}
    occ = spark.range(6000).select(F.lit("s").alias("source"), F.lit(1).alias("k1"), F.lit(2).alias("k2"), (F.col("id") % 2).alias("variant"), (F.col("id") % 2).cast("int").alias("container"), *[c.alias(n) for n, c in at(F.col("id") % 2500).items()])
    b = L.line_bitmaps(occ)
    assert b.agg(F.sum(F.bit_count("bits"))).first()[0] == 2500
    assert b.count() == 2 * 40 and b.filter("word = 0 AND shiftright(bits, 7) & 1L = 1L").count() == 1


def test_a_rare_line_costs_few_bytes(spark):
    docs = spark.range(200_000).select(F.concat(F.lit("d"), "id").alias("doc"), F.when(F.col("id") < 40, "small").otherwise("large").alias("source"))
    docs = docs.join(docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents")), "source")
    places = L.document_ordinals(docs)
    assert places.filter("source = 'small'").agg(F.count_distinct("container", "word")).first()[0] == 1
    assert places.groupBy("source", "container", "word", "bit").count().filter("count > 1").isEmpty()
    five = places.filter("source = 'large'").limit(5).select("source", F.lit(1).alias("k1"), F.lit(2).alias("k2"), F.lit(0).alias("variant"), "container", "word", "bit")
    b = L.line_bitmaps(five)
    assert b.count() <= 5 and dict(b.dtypes)["bits"] == "bigint"  # forty bytes of bitmap, whatever other documents there are
