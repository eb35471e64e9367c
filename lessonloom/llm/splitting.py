"""Splitting oversized items at natural boundaries (problem 5).

Agglomerative merging: the text is cut into atomic segments; adjacent segments sit in a heap ordered by the strength
of the boundary between them, and the weakest boundary is merged first while the combined size plus the overlap fits
the limit. What is left are the pieces; each but the first repeats the end of the one before it, from a natural
boundary inside the allowed overlap, or the whole of the overlap where it has none.

Null and short texts give no pieces. Empty texts neither. Repeated rows of a record are split once. A text without
any boundary is cut at the limit. Extra columns are kept out of the result unless named.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boundaries from strong to weak: (strength, pattern whose end is the cut).
BOUNDARIES = (
    (6, re.compile(r"\n(?=#{1,6} )")),
    (5, re.compile(r"\n[ \t]*\n\s*")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[.!?…。]+[\"'”’)\]]*\s+")),
    (2, re.compile(r"[,;:]\s+")),
    (1, re.compile(r"\s+|(?<=[;+*/=|])")),
)


def cuts(text: str) -> dict[int, int]:
    """Positions at which the text may be cut, with the strength of each; both ends are left out."""
    at: dict[int, int] = {}
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                at.setdefault(m.end(), strength)
    return at


def split_text(text: str, limit: int = 5200, overlap: int = 700) -> list[tuple[int, int, int]]:
    """(core start, start with overlap, end) of each piece; the cores follow each other without gap."""
    if len(text) <= limit:
        return [(0, 0, len(text))] if text else []
    room = limit - overlap
    at = cuts(text)
    edges = sorted(at)
    for a, b in zip([0, *edges], [*edges, len(text)]):  # segments that are too long by themselves
        for x in range(a + room, b, room):
            at[x] = 0
    edges = [0, *sorted(at), len(text)]
    n = len(edges) - 1
    start, end = edges[:-1], edges[1:]
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(at[edges[i + 1]], end[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        strength, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or right[i] != j or end[j] - start[i] != size or size > room:
            continue
        alive[j], end[i], right[i] = False, end[j], right[j]
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (at[start[right[i]]], end[right[i]] - start[i], i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (at[start[i]], end[i] - start[left[i]], left[i], i))
    pieces, inner = [], edges[1:-1]
    for i in range(n):
        if alive[i]:
            begin = start[i]
            if pieces and overlap:
                begin = _overlap_start(at, inner, pieces[-1][0], start[i], min(overlap, limit - (end[i] - start[i])))
            pieces.append((start[i], begin, end[i]))
    return pieces


def _overlap_start(at: dict[int, int], edges: list[int], floor: int, core: int, overlap: int) -> int:
    """The strongest boundary within ``overlap`` characters before ``core``, the earliest of equals; without any, the plain overlap."""
    from bisect import bisect_left

    low = max(floor, core - overlap)
    near = edges[bisect_left(edges, low) : bisect_left(edges, core)]
    natural = [x for x in near if at[x]]
    return max(natural, key=lambda x: (min(at[x], 3), -x)) if natural else low


def pieces(rows: DataFrame, *, record: str = "chunk_id", text: str = "normalized_text", keep: tuple[str, ...] = ("heading_path", "page_start", "page_end"), limit: int = 5200, overlap: int = 700) -> DataFrame:
    """(record, piece_no, n_pieces, start_char, end_char, overlap_chars, piece_text, kept columns) of every text over the limit.

    Only texts over the limit leave the JVM. ``start_char`` and ``end_char`` are code points of the stored text.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap has to be under the limit")
    long = rows.select(F.col(record).alias("rec"), F.col(text).alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep]).filter((F.length("text") > limit) & F.col("rec").isNotNull()).dropDuplicates(["rec"])
    schema = T.StructType([*long.drop("text").schema.fields, *[T.StructField(c, T.LongType()) for c in ("piece_no", "n_pieces", "start_char", "end_char", "overlap_chars")], T.StructField("piece_text", T.StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns(["text"])
            for k, text_value in enumerate(batch.column("text").to_pylist()):
                found = split_text(text_value, limit, overlap)
                n = len(found)
                own = [pa.concat_arrays([rest.column(c).slice(k, 1)]).take(pa.array([0] * n)) for c in range(rest.num_columns)]
                made = [pa.array(range(1, n + 1), pa.int64()), pa.array([n] * n, pa.int64()), pa.array([b for _, b, _ in found], pa.int64()), pa.array([e for *_, e in found], pa.int64()), pa.array([c - b for c, b, _ in found], pa.int64()), pa.array([text_value[b:e] for _, b, e in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *made], names=[f.name for f in schema.fields])

    out = long.select(*[c for c in long.columns if c != "text"], "text").mapInArrow(split, schema)
    return out.select(F.col("rec").alias(record), "piece_no", "n_pieces", "start_char", "end_char", "overlap_chars", "piece_text", *[F.col(f"kept_{c}").alias(c) for c in keep])
