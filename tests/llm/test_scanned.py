import numpy as np

from lessonloom.llm import scanned as S
from lessonloom.llm.boosting import Boosted

WORDS = "the model reads a long line of text and keeps its weights near zero self-attention fine-tuning variance gradient với mô hình trọng số của bước huấn luyện học máy điều kiện kalmer".split()


def test_boosting_learns():
    r = np.random.default_rng(1)
    x = r.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    m = Boosted(trees=40).fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.95


def test_shapes_and_words():
    assert S.shape("thc") == S.shape("the") and S.shape("cornp") == S.shape("comp")
    known = frozenset(WORDS)
    assert S.right_word("Model", known) and S.right_word("0.25", known) and S.right_word("—", known)
    assert not S.right_word("O.25", known) and not S.right_word("m0del", known)


def records(spark):
    own = [f"{a} {b}" for a, b in zip(WORDS, WORDS[3:])]
    page = lambda n: "\n".join([f"Kalmer model variance | {n}", f"The {own[n]} reads a long line of text and keeps its vari-", f"ance near {own[n + 1]}. The model reads fine-", f"tuning of {own[n + 2]} and keeps tbe weights near O.25.", "", f"The {own[n + 3]} reads", f"— {n}", "its weights near zero."])
    rows = [(f"r{n}", "d", n, n, "Kalmer model variance", page(n), "x") for n in range(1, 9)]
    rows += [("n", "d", 1, 1, None, None, "x"), ("b", None, None, None, None, "  ", "x"), rows[0]]
    return spark.createDataFrame(rows, "rec string, doc string, first int, last int, title string, text string, word string")


def words(spark):
    return spark.createDataFrame([(w, "en") for w in WORDS], "word string, kind string")


def test_noise_and_repair(spark):
    got = {tuple(r) for r in S.noise_lines(records(spark), words(spark)).collect()}
    want = {(f"r{n}", k, x) for n in range(1, 9) for k, x in ((1, "running_line"), (2, "split_word"), (4, "misread"), (7, "running_line"))}
    assert got == want
    fixed = {r.record_id: r.repaired_text for r in S.repaired_texts(records(spark), words(spark)).collect()}
    own = [f"{a} {b}" for a, b in zip(WORDS, WORDS[3:])]
    assert fixed["r3"] == f"The {own[3]} reads a long line of text and keeps its variance near {own[4]}. The model reads fine-tuning of {own[5]} and keeps the weights near 0.25.\n\nThe {own[6]} reads its weights near zero."
    assert S.number_of("3O.l8") == "30.18" and S.number_of("word") is None
    assert fixed["n"] is None and fixed["b"] == "  "


def test_empty(spark):
    assert S.noise_lines(records(spark).limit(0), words(spark)).count() == 0
    assert S.noise_lines(records(spark).filter("rec = 'n'"), words(spark)).count() == 0
    assert S.repaired_texts(records(spark).limit(0), words(spark).limit(0)).count() == 0


def test_misread_words_come_from_ranked_candidates(spark):
    plan = S.noise_lines(records(spark), words(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "(gram#" in plan and "ArrowEvalPython [score" in plan and "LeftSemi" in plan
    rows = [("r", "d", 1, 1, None, "the model reads kubernetes near zeppelin\nand tbe modcl keeps O.25")]
    df = spark.createDataFrame(rows, "rec string, doc string, first int, last int, title string, text string")
    assert {(r.line_no, r.noise) for r in S.noise_lines(df, words(spark)).collect()} == {(2, "misread")}


def test_right_words_that_the_list_lacks_are_not_explained(spark):
    known = sorted(set(WORDS))
    model = S.train_ranking(known, {})
    asked = spark.createDataFrame([(w,) for w in ("tokyo", "hurricane", "modcl", "rnodel", "trong9", "0.2S", "bươc")], "word string")
    listed = spark.createDataFrame([(w, 1) for w in known], "word string, frequency long")
    got = {r.word: r for r in S.corrections(asked, listed, model).collect()}
    assert all(got[w].explained >= S.MISREAD and got[w].best == b for w, b in (("modcl", "model"), ("rnodel", "model"), ("0.2S", "0.25"), ("bươc", "bước")))
    assert all(w not in got or got[w].explained < S.MISREAD for w in ("tokyo", "hurricane"))


def test_furniture_is_learned_from_planted_lines():
    r = np.random.default_rng(0)
    prose = ["the model reads a long line of text and keeps", "its weights near zero. Gradient bước học máy", "250  của  mô  hình  và  huấn  luyện  trọng  số,", "near zero.", "", "With the model"]
    text, labels = S.planted(prose, 4, ["kalmerbước"], "Kalmer bước", r)
    assert len(text) == len(labels) and len(text) - sum(labels) >= len(prose)
    model = S.train_furniture([("\n".join(prose), 4, ["kalmerbước"], "Kalmer bước")] * 200)
    page = ["KALMER BƯỚC", "the model reads a long line of text and keeps", "— 4", "its weights near zero. Gradient bước học máy", "250  của  mô  hình  và  huấn  luyện  trọng  số,", "near zero."]
    at, feats = S.line_features(page, 4, 4, ["kalmerbước"])
    assert [k for k, p in zip(at, model.predict(np.array(feats))) if p > 0.5] == [0, 2]


def test_chapter_header_of_a_large_document(spark):
    page = lambda n: ("Gradient bước học\n" if 40 <= n < 44 else "") + f"the model reads {WORDS[n % 9]}\n{WORDS[n % 7]} near zero."
    rows = [(f"r{n}", "d", n, n, "Kalmer", page(n)) for n in range(200)]
    df = spark.createDataFrame(rows, "rec string, doc string, first int, last int, title string, text string")
    got = {(r.record_id, r.line_no) for r in S.noise_lines(df, words(spark)).filter("noise = 'running_line'").collect()}
    assert got == {(f"r{n}", 1) for n in range(40, 44)}


def test_short_words_have_candidates(spark):
    asked = spark.createDataFrame([("ak",), ("gradknt",)], "word string")
    listed = spark.createDataFrame([("as", 3), ("variance", 2)], "word string, frequency long")
    assert [(r.word, r.best) for r in S.corrections(asked, listed, S.NO_RANKING).collect()] == [("ak", "as")]
