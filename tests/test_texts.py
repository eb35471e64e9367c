import struct

from pyspark.sql import functions as F

from lessonloom.functions import hashing
from lessonloom.functions import text as T
from lessonloom.operators import content as C
from lessonloom.operators import extension as E
from lessonloom.operators import texts as X


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_formulas():
    for tex, want in (
        (r"\frac{a_{1}}{\frac{b}{c}}", "(a₁) ÷ ((b) ÷ (c))"), (r"\sqrt{x+1}", "√(x + 1)"), (r"\hat{y}", "y\u0302"), (r"\sqrt[3]{8}", "³√(8)"), (r"$\alpha_{1} \unknown{z}$", "α₁ unknownz"),
        (r"\sigma=\sqrt{\frac{1}{n}\sum_{i=1}^{n}x_i^2}", "σ = √((1) ÷ (n)∑ᵢ₌₁ⁿxᵢ²)"), (r"h_v=\frac{m_1+m_2}{e_{1v}+e_{2v}}", "hᵥ = (m₁ + m₂) ÷ (e₁ᵥ + e₂ᵥ)"), (r"\(\nabla f \to 0\)", "∇ f → 0"), (r"\frac12", r"\frac12"), (r"\frac 12 + x_1", "(1) ÷ (2) + x₁"),
        (r"D:\raw\model\metrics.json", r"D:\raw\model\metrics.json"), ("hv=26/6≈4.33.", "hᵥ = 26/6 ≈ 4.33."), ("plain words", "plain words"), ("", ""), (r"\lambda^{", "λ"), (r"x_1}", "x₁"), (r"\begin{matrix}a_1\end{matrix}", "a₁"),
        (r"\mathrm{softmax}(z_i) \cdot \Delta", "softmax(zᵢ) · Δ"), ("{" * 3000 + "x_1" + "}" * 3000, "{" * 3000 + "x_1" + "}" * 3000),
    ):
        assert X.formula_text(tex) == want, tex
    assert X.formula_text(None) is None
    assert X._UP[ord("a")] == "ᵃ" and X._UP[ord("2")] == "²" and X._UP[ord("x")] == "ˣ" and X._DOWN[ord("v")] == "ᵥ" and X._DOWN[ord("j")] == "ⱼ"


def test_fractions():
    f = lambda s: (lambda x: x and (x["prefix"], x["numerator"], x["denominator"], x["suffix"]))(X.first_fraction(s))
    assert f(r"\frac{a_{1}}{b}") == ("", "a_{1}", "b", "") and f(r"x=\dfrac {1} {\frac{2}{3}}+y") == ("x=", "1", r"\frac{2}{3}", "+y")
    assert f(r"\frac{1}{2") is None and f(r"\frac12") is None and f("x") is None and f(None) is None


def test_case_folding(spark):
    assert one(spark, "Straße  MASSE", X.heading_key) == one(spark, "STRASSE masse", X.heading_key) == "strasse masse"
    assert one(spark, "Bước 1: ĐỌC", X.heading_key) == "bước 1 đọc" and one(spark, "ΣΊΣΥΦΟΣ", X.heading_key) == one(spark, "σίσυφος", X.heading_key)


def test_pictures(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    r = one(spark, bytearray(png), X.png_size, "binary")
    assert (r.width, r.height) == (640, 480) and one(spark, bytearray(b"GIF89a"), X.png_size, "binary") is None


def test_texts(spark):
    assert one(spark, "a\r\nb \t c\n\n\n\nd \u00a0", T.normalize_text) == "a\nb c\n\nd"
    assert one(spark, "  Bộ  NHỚ đệm ", T.search_fold) == "bo nho dem"
    assert one(spark, "Xong rồi.Tiếp theo", X.spaced_sentences) == "Xong rồi. Tiếp theo"
    assert one(spark, 'nói "a', X.takeaway_problem) == "ODD_QUOTES" and one(spark, "fine", X.takeaway_problem) is None
    assert one(spark, "See https://a.b/c in notes.pdf (trang 12) now", X.plain_learner_text) == "See in now"
    assert one(spark, 'text ```{"a": {"b": 1}}``` end', X.json_payload) == '{"a": {"b": 1}}'
    assert one(spark, "none", X.json_payload) is None
    assert one(spark, "..\\x/evil name?.txt", C.safe_filename) == "evil_name_.txt"
    assert [one(spark, p, C.unsafe_path) for p in ("a/b", "/a", "a/../b", "C:\\x", "a//b")] == [False, True, True, True, True]


def test_identities(spark):
    import hashlib

    df = spark.createDataFrame([("a", "b"), ("a", None)], "x string, y string")
    ids = [r.i for r in df.select(hashing.stable_id("doc", F.col("x"), F.col("y")).alias("i")).collect()]
    assert ids == ["doc_" + hashlib.sha256(b"a\x1fb").hexdigest()[:16], None]


def test_answer_orders_are_permutations(spark):
    df = spark.range(6).select(F.lit("atom_1").alias("a"), F.col("id").cast("int").alias("k"))
    got = [r.t for r in df.select(C.answer_order(F.col("a"), F.col("k")).alias("t"), "k").orderBy("k").collect()]
    assert sorted(got[:4]) == [0, 1, 2, 3] and set(got[4:]) <= {0, 1, 2, 3}
    o = spark.range(1).select(C.rotated(F.array(*[F.lit(x) for x in "pqrs"]), F.lit(2), F.lit(0)).alias("o")).first().o
    assert o == ["r", "s", "p", "q"]


def test_strict_json():
    assert E.strict_json_error('{"a": 1}') is None
    assert E.strict_json_error('{"a": 1, "a": 2}') == "REPEATED_KEY"
    assert E.strict_json_error('{"a": NaN}') == "NOT_FINITE" and E.strict_json_error('{"a": 1e999}') == "NOT_FINITE"
    assert E.strict_json_error("{") == "MALFORMED" and E.strict_json_error("[1]") == "NO_OBJECT" and E.strict_json_error(None) == "NULL"


def test_external_failures_are_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", None)], "k string, n int")
    out = {r.k: (r.status, r.error) for r in E.external(df, "k", ["n"], lambda r: {"v": 1 / r["n"]}, lambda o: None if o["v"] > 2 else "SMALL").collect()}
    assert out["a"] == ("FAILED", "SMALL") and out["b"][0] == "FAILED" and "ZeroDivision" in out["b"][1] and "TypeError" in out["c"][1]


def test_splice_and_mask(spark):
    rows = spark.createDataFrame([("p", "a", 0), ("q", "b", 1), ("q", "c", 2), ("r", "d", 3)], "pack string, atom string, n int")
    new = spark.createDataFrame([("q", "x", 0), ("q", "y", 1), ("q", "z", 2)], rows.schema)
    got = [(r.atom, r.n) for r in E.spliced(rows, new, "pack", "n", "q").orderBy("n").collect()]
    assert got == [("a", 0), ("x", 1), ("y", 2), ("z", 3), ("d", 4)]
    shown = E.masked(rows, rows.filter("atom = 'a'"), "atom", "pack", True).orderBy("n").collect()
    assert [r.pack for r in shown] == ["p", None, None, None]


def test_previous_and_group_numbers(spark):
    rows = spark.createDataFrame([("g", k, k * k) for k in range(50)] + [("h", 7, 1), (None, 3, 9), (None, 1, 8)], "g string, k int, v int")
    prev = {(r.g, r.k): r.prev_v for r in C.with_previous(rows, ["g"], ["k"], ["v"], buckets=5).collect()}
    assert prev["g", 0] is None and prev["g", 9] == 64 and prev["h", 7] is None and prev[None, 3] == 8 and prev[None, 1] is None
    n = {(r.g, r.k): r.n for r in C.group_number(rows.filter("g IS NOT NULL"), ["g"], ["k"], "n", buckets=5).collect()}
    assert all(n["g", k] == k for k in range(50)) and n["h", 7] == 0
