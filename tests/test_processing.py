import io
import shutil
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lessonloom.operators import chunking, content, labs, memo, partitioning, quality
from lessonloom.sources import archives, sinks
from lessonloom.streaming import signals


@given(st.text(alphabet="ab \n\U0001f600đ", max_size=900), st.integers(4, 60))
@settings(max_examples=60, deadline=None)
def test_display_pages_lose_nothing(text, size):
    pages = chunking.display_pages(text, size)
    assert "".join(pages) == text
    assert all(0 < len(p.encode("utf-16-le")) // 2 <= size for p in pages)


def test_sections_keep_heading_paths():
    text = "intro\n# A\nx\n## B\ny\n```\n# in code\n```\n# C\n"
    assert [p for p, _ in chunking.sections(text)] == [[], ["A"], ["A", "B"], ["in code"], ["C"]]


def test_windows_overlap_and_end_at_empty_lines():
    text = "a" * 3000 + "\n\n" + "b" * 4000
    parts = chunking.windows(text)
    assert parts[0] == "a" * 3000 and parts[1].startswith("a" * 700) and max(map(len, parts)) <= 5200


def test_chunks_are_stable(spark):
    df = spark.createDataFrame([("d", 1, "# T\nx\n\ny"), ("d", 2, ""), ("d", 3, None)], "document_id string, page long, text string")
    a, b = chunking.chunks(df).collect(), chunking.chunks(df).collect()
    assert a == b and len(a) == 1 and a[0].chunk_id.startswith("chunk_")


def test_windows_in_golden_cases():
    assert chunking.windows("ab cd", 10, 2) == ["ab cd"]
    assert chunking.windows("x" * 25, 10, 3) == ["x" * 10, "x" * 10, "x" * 10, "x" * 4]
    assert chunking.windows("aaaaaa\n\nbbbbbbbbbb", 10, 2) == ["aaaaaa", "aa\n\nbbbbbb", "bbbbbb"]
    assert chunking.windows("aa\n\nbbbbbbbbbbbbbb", 10, 2)[0] == "aa\n\nbbbbbb"


def test_first_clause_golden():
    for text, want in (
        ("Dùng bộ nhớ đệm: lưu kết quả", "Dùng bộ nhớ đệm"), ("Vì sao học sâu? Vì dữ liệu", "Vì sao học sâu"), ("a,b c", "a"), ("tính 3.5 lần. Sau đó", "tính 3.5 lần"), ("gọi f(a; b]) rồi, xong", "gọi f(a; b]) rồi"),
        ("mở (ngoặc, không đóng", "mở (ngoặc, không đóng"), ("x [a{b,c}] y; z", "x [a{b,c}] y"), ("`a, b", "`a, b"), ("", ""), ("hết.", "hết"), ("([), x", "([), x"),
    ):
        assert chunking.first_clause(text) == want, text


def test_first_clause():
    assert chunking.first_clause("f(a, b), then") == "f(a, b)"
    assert chunking.first_clause("`x, y`; z") == "`x, y`"
    assert chunking.first_clause(None) is None


def _parts(weights, count):
    """The stated rule by trying every cut."""
    ends, done, n = [], 0, len(weights)
    for part in range(count):
        left = count - part
        if left == 1:
            ends.append(n)
            break
        goal, first = sum(weights[done:]) / left, done
        cuts = range(first + 1, n - left + 2)
        ends.append(min(cuts, key=lambda c: (abs(sum(weights[first:c]) - goal), c)))
        done = ends[-1]
    return [sum(e <= k for e in ends) for k in range(n)]


def test_balanced_parts_equal_the_rule(spark):
    import random

    r = random.Random(3)
    lists = {f"d{k}": [r.choice([0, 1, 1, 2, 5, 9, 40]) for _ in range(r.choice([1, 2, 3, 7, 12, 30]))] for k in range(40)}
    rows = [(k, i * 3, w) for k, ws in lists.items() for i, w in enumerate(ws)] + [("none", 0, None)]
    got = {(x.k, x.o): x.part for x in partitioning.balanced_parts(spark.createDataFrame(rows, "k string, o int, w int"), "k", "o", "w").collect()}
    for k, ws in lists.items():
        want = _parts([max(1, w) for w in ws], min(5, len(ws), max(1, -(-len(ws) // 4))))
        assert [got[k, i * 3] for i in range(len(ws))] == want
    assert got["none", 0] == 0 and partitioning.balanced_parts(spark.createDataFrame([], "k string, o int, w int"), "k", "o", "w").count() == 0


def test_running_totals_of_one_large_group(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") % 7).alias("v")).unionByName(spark.createDataFrame([(None, 1, 5), (None, 2, 6)], "g string, k long, v long"))
    got = {(r.g, r.k): r.s for r in content.running_totals(df, ["g"], ["k"], {"v": "s"}, buckets=9).collect()}
    total = 0
    for k in range(3000):
        total += k % 7
        assert got["g", k] == total
    assert got[None, 2] == 11


def test_uncovered_pages(spark):
    wholes = spark.createDataFrame([("a", 10), ("b", 3), ("c", 2), ("d", 1_000_000_000)], "d string, n int")
    parts = spark.createDataFrame([("a", 2, 3), ("a", 2, 5), ("a", 4, 4), ("a", 8, 99), ("b", 1, 3), ("c", None, 2), ("c", 2, 1), ("d", 5, 999_999_999), ("e", 1, 1)], "d string, f int, t int")
    got = sorted((r.d, r.page_from, r.page_to) for r in partitioning.uncovered(wholes, parts, "d", "n", "f", "t").collect())
    assert got == [("a", 1, 1), ("a", 6, 7), ("c", 1, 2), ("d", 1, 4), ("d", 1_000_000_000, 1_000_000_000)]


def test_dropped_signals_do_not_count(spark):
    import datetime

    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(1, 7, "view", 0), (2, 7, "view", 90), (3, 7, "view", 180), (4, 7, "click", 185), (5, 7, "view", 190), (6, 7, "view", 191), (7, 8, "view", 191), (8, 7, "view", 320), (9, 9, None, 1)]
    e = spark.createDataFrame([(i, u, k, at(m)) for i, u, k, m in rows], "event_id long, user_id long, event_type string, ts timestamp_ntz")
    assert sorted(r.event_id for r in signals.without_repeats(e, "view", 7_200_000_000).collect()) == [1, 3, 4, 5, 7, 8, 9]


def test_blobs_are_written_once(spark, tmp_path):
    import hashlib

    import pytest

    f = lambda *xs: spark.createDataFrame([(hashlib.sha256(x).hexdigest(), bytearray(x), "n") for x in xs], "sha256 string, content binary, prefix string")
    path = f"file://{tmp_path}/blobs"
    sinks.write_blobs(f(b"a", b"b", b"a"), path)
    sinks.write_blobs(f(b"b", b"c"), path)
    assert sorted(bytes(r.content) for r in spark.read.parquet(path).collect()) == [b"a", b"b", b"c"]
    wrong = spark.createDataFrame([(hashlib.sha256(b"a").hexdigest(), bytearray(b"z"))], "sha256 string, content binary")
    with pytest.raises(ValueError):
        sinks.write_blobs(wrong, path)
    with pytest.raises(ValueError):
        sinks.write_blobs(f(b"q").unionByName(wrong.withColumn("prefix", F.lit("x"))).unionByName(f(b"a")), f"{path}2")


def test_page_ranges(spark):
    r = spark.range(1).select(partitioning.page_ranges(F.lit(10), 4).alias("r")).first().r
    assert [tuple(x) for x in r] == [(1, 4), (5, 8), (9, 10)]
    assert [spark.range(1).select(partitioning.atom_count(F.lit(n), t).alias("n")).first().n for n, t in ((11, 4), (25, 5))] == [3, 5]


def test_labs(spark):
    one = spark.range(1)
    m = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))
    losses = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    r = one.select(labs.convolve(m, [[1.0, 0.0], [0.0, -1.0]]).alias("c"), labs.gradient_step(F.lit(2.0), F.lit(0.5), F.lit(0.1)).alias("g"), labs.first_overfit(losses(3, 2, 1), losses(3, 2, 4)).alias("o"), F.size(labs.curve("RELU", -1, 1, 4)).alias("n")).first()
    assert r.c == [[-3.0]] and abs(r.g - 1.95) < 1e-12 and r.o == 3 and r.n == 5
    rows = [(0, 0)] * 8 + [(0, 1)] * 2 + [(1, 0)] + [(1, 1)] * 9
    c = labs.confusion(spark.createDataFrame(rows, "a int, p int"), "a", "p").first()
    assert abs(c.accuracy - 0.85) < 1e-9 and abs(c.macro_recall - 0.85) < 1e-9


def test_similar_in_group_equals_all_pairs(spark):
    rows = [("g", f"q{i}", t.split()) for i, t in enumerate(["a b c d e", "a b c d f", "a b c d e", "x y", "x y z", ""])] + [("h", "q9", "a b c d e".split())]
    df = spark.createDataFrame(rows, "g string, id string, w array<string>")
    got = {(r.a, r.b) for r in content.similar_in_group(df, "g", "id", "w", 0.5).collect()}
    want = {(a, b) for _, a, x in rows[:6] for _, b, y in rows[:6] if a < b and len(set(x) & set(y)) / max(1, len(set(x) | set(y))) > 0.5}
    assert got == want


def test_global_number_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    rows = content.global_number(df, ["k"], "n", buckets=7).collect()
    assert all(r.k == r.n for r in rows) and len(rows) == 1000


def test_a_broken_row_breaks_one_rule(spark):
    t = {"a": spark.createDataFrame([("x", ["y"], 3), ("y", None, 9)], "id string, refs array<string>, n int")}
    rules = [quality.RowRule("RANGE", "a", ~F.col("n").between(1, 5)), quality.ReferenceRule("REF", "a", "refs", "a", F.col("id")), quality.UniqueRule("UNIQUE", "a", F.col("n"))]
    assert [(r.code, r.path) for r in quality.issues(t, {"a": "id"}, rules).collect()] == [("RANGE", "a:y")]


def test_manifest_sees_changes_but_not_order(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "k int, v string")
    b = a.orderBy(F.desc("k")).repartition(3)
    c = spark.createDataFrame([(1, None), (2, "x"), (2, "y")], "k int, v string")
    m = lambda df: memo.manifest({"t": df})
    assert memo.manifest_differences(m(a), m(b)).count() == 0
    assert [r.state for r in memo.manifest_differences(m(a), m(c)).collect()] == ["changed"]
    assert memo.manifest_differences(memo.manifest({"t": a, "u": a}), m(a)).first().state == "missing"


def test_memo_computes_what_is_missing(spark):
    inputs = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    cache = spark.createDataFrame([("a", "READY", "1"), ("b", "FAILED", None)], "cache_key string, status string, out string")
    done = memo.run(inputs, cache, lambda df: df.select("cache_key", F.lit("READY").alias("status"), F.lit("new").alias("out")))
    assert {(r.cache_key, r.out) for r in done.collect()} == {("a", "1"), ("b", "new"), ("c", "new")}


def test_install_moves_the_pointer_last(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    root = f"file://{tmp_path}/catalog"
    first = sinks.install(spark, root, {"t": df})
    assert sinks.current(spark, root, "t").count() == 1
    assert sinks.install(spark, root, {"t": df.unionByName(df)}) != first
    assert sinks.current(spark, root, "t").count() == 2
    assert sinks.install(spark, root, {"t": df.repartition(3)}) == first and sinks.current(spark, root, "t").count() == 1
    assert sinks.verified(spark, root).count() == 0
    shutil.rmtree(tmp_path / "catalog" / "data" / max(spark.read.parquet(f"{root}/current").collect()).folder / "t")
    assert [tuple(r) for r in sinks.verified(spark, root).collect()] == [("t", "missing")]


def _zip(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for n, v in files:
            z.writestr(n, v)
    return b.getvalue()


def test_archives(spark):
    raw = _zip([("a/x.md", "# T\nhello"), ("b/y.txt", "# T\nhello"), ("../evil.txt", "no"), ("big.txt", "0" * 1_000_000), ("p.png", "img")])
    df = spark.createDataFrame([("one.zip", bytearray(raw)), ("two.zip", bytearray(b"no zip"))], "path string, content binary")
    rows = {r.member: r for r in archives.archive_members(df).collect()}
    assert rows["../evil.txt"].problem == "TRAVERSAL" and rows["big.txt"].problem == "BOMB" and rows[None].problem == "NOT_AN_ARCHIVE"
    inv = archives.inventory(archives.archive_members(df)).collect()
    assert len(inv) == 1 and inv[0].canonical == "a/x.md" and inv[0].occurrences == 2
    pages = archives.extracted_pages(archives.archive_members(df).filter("problem IS NULL AND suffix IN ('md', 'txt')").dropDuplicates(["sha256"])).collect()
    assert [p.text for p in pages] == ["# T\nhello"]


def test_office_documents():
    a, p, r = ("http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships")
    slide = lambda t: f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cNvPr descr="pic"/><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>'
    rel = '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>'
    raw = _zip([("ppt/presentation.xml", f'<p:presentation xmlns:p="{p}" xmlns:r="{r}"><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>'), ("ppt/_rels/presentation.xml.rels", rel), ("ppt/slides/slide1.xml", slide("one")), ("ppt/slides/slide2.xml", slide("two")), ("ppt/media/m.png", "x")])
    assert archives.slides(raw) == ["two\nMô tả hình: pic", "one\nMô tả hình: pic"]
    assert [(n, used) for n, _, used in archives.media(raw)] == [("ppt/media/m.png", False)]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    par = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    doc = f'<w:document xmlns:w="{w}"><w:body>{par("intro")}{par("T", "Heading1")}{par("x")}<w:tbl><w:tr><w:tc>{par("a")}</w:tc><w:tc>{par("b")}</w:tc></w:tr></w:tbl></w:body></w:document>'
    assert archives.virtual_pages(_zip([("word/document.xml", doc)])) == ["intro", "# T\n\nx\n\na | b"]


def test_transitions_and_no_ops():
    s = signals.State()
    assert signals.advance(s, "RIGHT", 0).revision == 0
    s = signals.advance(s, "ENABLE", 0)
    s = signals.advance(s, "OFF", 10_000)
    assert (s.inactive, s.revision) == (True, 2)
    assert signals.advance(s, "OFF", 11_000) == s
    on = signals.advance(s, "ON", 12_000)
    assert (on.inactive, on.accepted) == (False, True) and signals.advance(on, "ON", 13_000).revision == on.revision
    done = signals.advance(on, "DONE", 14_000)
    assert done.mode == "READY_QUIZ" and signals.advance(done, "WRONG", 15_000).revision == done.revision
    assert signals.advance(done, "unknown", 1) == done


def test_composed_form_of_any_text(spark):
    import unicodedata

    from lessonloom.functions.text import nfc

    texts = ["", "plain", "Tiếng Việt\nhai dòng", unicodedata.normalize("NFD", "Tiếng Việt"), "Å   \U0001f600", "ệ", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", nfc(F.col("t")).alias("c")).collect()
    assert all(r.c == (None if r.t is None else unicodedata.normalize("NFC", r.t)) for r in rows)


def test_samples_are_bounded_and_stable(spark):
    from lessonloom.runtime import sampled

    df = spark.range(5000).withColumnRenamed("id", "k")
    a = sampled(df, "k", 200).collect()
    assert len(a) == 200 and sorted(a) == sorted(sampled(df.repartition(7), "k", 200).collect())
    assert sampled(df, "k", 6000).count() == 5000
