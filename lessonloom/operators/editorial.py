"""Editorial columns: observable objectives, canonical objectives, titles of atoms, filler labels, allow-lists with a veto."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lessonloom.functions.text import nfkc
from lessonloom.operators.chunking import clause
from lessonloom.operators.content import by_rules

#: What a learner does in an observable objective (fixed values).
ACTIONS_VI = (
    "giải thích, phân biệt, áp dụng, vận dụng, tính, mô tả, mô phỏng, diễn đạt, lần theo, truy vết, trace, nhận diện, xác định, triển khai, cấu hình, so sánh, đánh giá, phân tích, thực hiện, xây dựng, kiểm tra, lựa chọn, chọn, "
    "sử dụng, dùng, dự đoán, chứng minh, khởi tạo, tạo, thay đổi, phát biểu, cài đặt, viết, liệt kê, nêu, chỉ ra, sắp xếp, trình bày, diễn giải, đọc, ghi, lưu, thêm, xóa, sửa, chạy, tái tạo, khôi phục, phục hồi, theo dõi, quan sát, "
    "đối chiếu, liên kết, tổ chức, quản lý, thiết kế, thiết lập, mở, biến, chẩn đoán, khắc phục, thử nghiệm, đo, ước lượng, tối ưu, phân rã, tổng hợp, chuẩn hóa, chuyển đổi, giải quyết, suy luận"
).split(", ")
ACTIONS_EN = (
    "explain distinguish apply calculate describe identify deploy configure compare evaluate analyze implement build verify use list read write run track restore reproduce monitor inspect troubleshoot diagnose solve"
).split()
#: Untranslated filler and its label, the first that is found (fixed values).
FILLERS = (
    (r"(?iU)\b(?:data\s+files?|code|dataset|dữ\s+liệu)\s+(?:không\s+|chưa\s+|được\s+)?connected\b", "raw 'connected' filler"),
    (r"(?iU)\bonly\s+(?:model\s+serving|eval(?:uation)?\s+result|model\s+name)\b|\bdataset\s+v\d+\s+only\b", "raw 'Only ...' filler"),
    (r"(?iU)\binitialize\s+problem\b", "raw 'Initialize Problem' filler"),
)
_LEAD = r"(?:(?:sau\s+(?:bài(?:\s+học)?\s+này|khi\s+học\s+xong)[,:]?\s*)?(?:(?:người\s+học|bạn)\s+)?(?:(?:sẽ|có\s+thể)\s+)?)"
_VAGUE = rf"(?iU)^\s*{_LEAD}(?:hiểu(?:\s+được)?|nắm(?:\s+được)?|biết)\s+(?:rõ\s+)?(?:về\s+)?"


def action_pattern(end: str = r"\b") -> str:
    """Matches texts that begin with a learner's action; ``end`` is what follows it."""
    said = "|".join(a.replace(" ", r"\s+") for a in ACTIONS_VI)
    return rf"^\s*(?:{_LEAD}(?:{said})|(?:(?:learner|you)\s+(?:can\s+)?)?(?:{'|'.join(ACTIONS_EN)})){end}"


def observable(c: Column) -> Column:
    """Whether an objective begins with something a learner does."""
    return c.rlike("(?iU)" + action_pattern())


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _n_words(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_À-ỹ]+"), F.lit(0)))


def _bare_title(title: Column) -> Column:
    return F.btrim(_spaced(title), F.lit(" .,:;!?"))


def canonical_objective(objective: Column, title: Column) -> Column:
    """One short objective: the first clause if it is observable, else what it wants understood, else the title's role."""
    first = F.coalesce(clause(_spaced(objective)), F.lit(""))
    body = F.btrim(F.regexp_replace(first, _VAGUE, ""), F.lit(" .,:;!?"))
    own = _n_words(first).between(6, 28) & observable(first)
    vague = _n_words(body).between(4, 24) & (body != F.btrim(first, F.lit(" .,:;!?")))
    role = F.concat(F.lit("Người học có thể mô tả vai trò của "), F.coalesce(_bare_title(title), F.lit("")), F.lit(" trong nội dung đang học."))
    return F.when(own, F.concat(F.rtrim(first, F.lit(".,;:!?")), F.lit("."))).when(vague, F.concat(F.lit("Người học có thể mô tả "), body, F.lit("."))).otherwise(role)


def is_fallback(objective: Column, title: Column) -> Column:
    """Whether an objective says no more than its title does."""
    t, low = _bare_title(title), F.lower(_spaced(objective))
    return (low == F.lower(F.concat(F.lit("Người học có thể giải thích khái niệm "), t, F.lit(".")))) | (low == F.lower(F.concat(F.lit("Người học có thể mô tả vai trò của "), t, F.lit(" trong nội dung đang học."))))


def raw_filler(c: Column) -> Column:
    """The label of the first filler in a text; null if there is none."""
    return F.nullif(by_rules(nfkc(c), list(FILLERS), ""), F.lit(""))


def unit_title(headings: Column, text: Column, base: Column, first: Column, last: Column) -> Column:
    """The nearest heading that isn't blank, else the first line of four characters, else ``base``; with the pages."""
    clean = lambda c: F.left(F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" .-_\t\r\n")), F.lit(180))
    head = F.get(F.filter(F.transform(F.reverse(headings), clean), lambda h: h != ""), 0)
    line = F.get(F.filter(F.transform(F.split(text, r"\r\n?|[\n\x0b\x0c]"), F.trim), lambda x: F.length(x) >= 4), 0)
    pages = F.when(first == last, F.concat(F.lit("trang "), first)).otherwise(F.concat(F.lit("trang "), first, F.lit("–"), last))
    return clean(F.concat(F.coalesce(head, F.nullif(clean(line), F.lit("")), base), F.lit(" · "), pages))


def allowed(value: Column, known: list[str], text: Column, vetoes: dict[str, str]) -> Column:
    """Whether a value is on the list and the text holds no word that vetoes it."""
    veto = F.lit(False)
    for v, word in vetoes.items():
        veto = veto | ((value == v) & F.lower(text).contains(word))
    return F.coalesce(value.isin(*known) & ~veto, F.lit(False))
