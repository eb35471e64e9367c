from hypothesis import given, settings
from hypothesis import strategies as st

from lessonloom.llm import splitting as S


@given(st.text(alphabet="ab .\n,#\U0001f600", max_size=600), st.integers(20, 90), st.integers(0, 15))
@settings(max_examples=150, deadline=None)
def test_pieces_cover_in_order_under_the_limit(text, limit, overlap):
    pieces = S.split_text(text, limit, overlap)
    at = 0
    for core, begin, end in pieces:
        assert core == at and begin <= core < end and end - begin <= limit and core - begin <= overlap
        at = end
    assert at == len(text)
    assert all(a[0] <= b[1] for a, b in zip(pieces, pieces[1:]))


def test_natural_boundaries_win():
    text = ("Câu một dài vừa phải. " * 20).strip() + "\n\n" + ("Đoạn hai cũng vậy. " * 20).strip()
    pieces = S.split_text(text, 500, 60)
    assert text[: pieces[0][2]].endswith("\n\n") or text[: pieces[0][2]].rstrip().endswith(".")
    assert all(text[: e].rstrip()[-1] in ".!?" for *_, e in pieces)
    assert S.split_text("x" * 1000, 300, 50)[0][2] <= 300


def test_rows(spark):
    df = spark.createDataFrame([("a", "w " * 60, ["h"], 1, 2, 9), ("a", "w " * 60, ["h"], 1, 2, 9), ("b", "short", ["h"], 1, 1, 9), ("c", None, None, None, None, 9), (None, "w " * 60, None, 1, 1, 9), ("d", "", [], 1, 1, 9)], "chunk_id string, normalized_text string, heading_path array<string>, page_start int, page_end int, rec int")
    rows = S.pieces(df, limit=50, overlap=10).orderBy("piece_no").collect()
    assert {r.chunk_id for r in rows} == {"a"} and [r.piece_no for r in rows] == list(range(1, len(rows) + 1))
    assert rows[0].heading_path == ["h"] and rows[0].page_end == 2 and all(len(r.piece_text) <= 50 for r in rows)
    assert S.pieces(df.limit(0), limit=50, overlap=10).count() == 0


def test_plain_overlap_without_boundaries():
    assert S.split_text("x" * 6000) == [(0, 0, 4500), (4500, 3800, 6000)]
    assert S.split_text("a" * 40 + " " + "b" * 60, 50, 10)[1][:2][1] <= 41
