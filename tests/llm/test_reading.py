from lessonloom.llm import reading as R

EASY = "Con gà rất nhỏ. Em đếm được 3 cái cân. Bạn Mai thấy chiếc ô. Con mèo này vui. Ta xếp hạt đậu vào hộp. Máy sai thì thử lại. "
HARD = "Giả sử kỳ vọng có điều kiện theo bộ lọc được thoả mãn với hằng số 0.8487, khi đó hạng hiệu dụng của toán tử kéo theo rằng học chuyển giao của lược đồ Heotreom tổng hợp điểm số với sai khác không quá 0.6685, miễn là phân kỳ giữa hai độ đo còn hiệu lực trên toàn bộ miền (xem tr. 6), v.v., dưới nhiễu cộng tính. "


def test_sentences():
    assert len(R.sentences(EASY.strip())) == 6 and len(R.sentences(HARD.strip())) == 1
    assert len([s for s in R.sentences("Một dòng\nHai dòng\nBa dòng") if s]) == 3
    assert len([s for s in R.sentences("một câu dài bị\nngắt thành nhiều\ndòng liền nhau.") if s]) == 1
    assert len([s.strip() for s in R.sentences("# Tiêu đề\n- mục một\n- mục hai\nSource: abc") if s.strip()]) == 2


def test_levels(spark):
    docs = [(i, EASY * (1 + i % 3), "vi", "a", 1) for i in range(40)] + [(100 + i, HARD * (1 + i % 3), "vi", "b", 1) for i in range(40)]
    docs += [(200, None, "vi", "a", 1), (201, " ", None, None, 1), (202, "Quá ngắn.", "vi", "a", 1), (None, EASY, "vi", "a", 1), (0, EASY, "vi", "a", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, level int")
    labels = spark.createDataFrame([(i, "x", 1) for i in range(20)] + [(100 + i, None, 5) for i in range(20)] + [(3, "y", None), (None, "z", 3)], "doc_id long, annotator string, reading_level int")
    got = {r.doc_id: r.reading_level for r in R.reading_levels(df, labels).collect()}
    assert len(got) == 83 and all(got[i] < 4 for i in range(40)) and all(got[100 + i] >= 4 for i in range(40))
    assert got[200] is None and got[201] is None and got[202] is None
    p = R.profile(R.reading_levels(df, labels.limit(0)))
    assert sum(r.documents for r in p.collect()) == 83
    assert R.reading_levels(df.limit(0), labels).count() == 0


def test_both_terms_count_without_labels():
    b, cuts = R.fit([])
    assert b[1] > 0 and b[2] > 0 and cuts == sorted(cuts)


def test_levels_hold_on_documents_not_fitted_on():
    import random

    r = random.Random(2)
    rows = [(u := 0.05 * y + r.gauss(0, 0.01), s := 4.0 * 1.6**y, float(y)) for y in (1, 2, 3, 4, 5) for _ in range(60)]
    r.shuffle(rows)
    b, cuts = R.fit(rows[:150])
    import math

    level = lambda u, s: 1 + sum(b[0] + b[1] * u + b[2] * math.log(s) >= c for c in cuts)
    assert sum(level(u, s) == y for u, s, y in rows[150:]) >= 140
