import os

import pytest
from pyspark.sql import functions as F

from lessonloom.llm import queries as Q

from .. import oracle


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, data, name):
    oracle.same(Q.QUERIES[name](spark, data), oracle.database(data), Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_query_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() > 0


#: All pairs by prefix words in SQL: too slow for more than the smallest tables, so no query's oracle.
PAIRS = r"""
WITH t AS (SELECT DISTINCT 'document_chunks' AS g, chunk_id AS id, normalized_text AS x FROM document_chunks UNION SELECT 'lessons', lesson_id, learning_objective FROM lessons),
w AS (SELECT g, id, list_distinct(regexp_extract_all(lower(nfc_normalize(x)), '[\p{L}\p{N}]+')) AS ws FROM t WHERE id IS NOT NULL AND x IS NOT NULL),
s AS (SELECT g, id, ws, len(ws) AS n, row_number() OVER (ORDER BY g, id) AS k FROM w WHERE len(ws) >= 12),
d AS (SELECT k, g, n, unnest(ws) AS word FROM s),
f AS (SELECT g, word, count(*) AS df FROM d GROUP BY ALL),
r AS (SELECT k, g, n, word, row_number() OVER (PARTITION BY k ORDER BY df, word) AS pos FROM d JOIN f USING (g, word)),
c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM r a JOIN r b ON a.g = b.g AND a.word = b.word AND a.k < b.k AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n WHERE a.pos <= a.n - ceil(0.7 * a.n) + 1 AND b.pos <= b.n - ceil(0.7 * b.n) + 1)
SELECT x.g AS table_name, least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM c JOIN s x ON x.k = c.a JOIN s y ON y.k = c.b WHERE x.id <> y.id AND len(list_intersect(x.ws, y.ws)) * 10 >= 7 * (x.n + y.n - len(list_intersect(x.ws, y.ws)))
"""


def test_pairs_equal_sql_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    oracle.same(Q.QUERIES["p2_found"](spark, d), oracle.database(d), PAIRS)


def test_packing_and_mixing_keep_their_bounds(spark, data):
    packed = Q.QUERIES["p7_packed"](spark, data)
    fill = packed.groupBy("container_name", "container_id", "capacity_tokens").agg(F.sum("piece_tokens").alias("t"))
    assert fill.filter("t > capacity_tokens").count() == 0
    per = packed.groupBy("container_name", "doc_id", "n_pieces").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece_no").alias("k"), F.sum("piece_tokens").alias("t"))
    assert per.filter("n <> n_pieces OR k <> n_pieces").count() == 0
    assert per.groupBy("doc_id").agg(F.count_distinct("t").alias("sizes")).filter("sizes > 1").count() == 0
    shares = Q.QUERIES["p8_shares"](spark, data).collect()
    assert all(r.most_repeats <= r.max_repeats and r.drawn_tokens <= r.planned_tokens <= r.tokens * r.max_repeats for r in shares)
    assert abs(sum(r.actual_share for r in shares) - 1) < 1e-9 and abs(sum(r.target_share for r in shares) - 1) < 1e-9


def test_pieces_and_profile(spark, data):
    pieces = {}
    for r in Q.QUERIES["p5_pieces"](spark, data).collect():
        pieces.setdefault(r.chunk_id, []).append(r)
    texts = {r.chunk_id: r.normalized_text for r in spark.read.parquet(f"{data}/document_chunks.parquet").filter("length(normalized_text) > 5200").collect()}
    assert set(pieces) == set(texts)
    for c, ps in pieces.items():
        ps.sort(key=lambda r: r.piece_no)
        assert all(p.piece_text == texts[c][p.start_char : p.end_char] and len(p.piece_text) <= 5200 and p.overlap_chars <= 700 for p in ps)
        assert ps[0].start_char == 0 and ps[-1].end_char == len(texts[c]) and all(a.end_char - b.start_char == b.overlap_chars for a, b in zip(ps, ps[1:]))
    levels, profile = Q.QUERIES["p9_levels"](spark, data), Q.QUERIES["p9_profile"](spark, data)
    assert sum(r.documents for r in profile.collect()) == levels.count()
