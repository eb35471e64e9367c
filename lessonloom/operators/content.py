"""Documents, chunks and lessons: ordered grouping, running numbers, hashes, conflicts and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lessonloom.functions.text import nullif_blank, search_fold


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    g = rows.groupBy(*key).agg(F.min(F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], *[F.col(c) for c in rest if c not in order])).alias("_b"))
    back = {c: f"_b._o{k}" for k, c in enumerate(order)}
    return g.select(*key, *[F.col(back.get(c, f"_b.{c}")).alias(c) for c in rest])


def exact_duplicates(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(key, copies, canonical): items that share a digest, canonical the least. Null keys are dropped; no list of copies is built."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(item).alias("copies"), F.min(item).alias("canonical"))


def aliases(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(item, canonical): each item with the canonical one of its digest, as rows."""
    one = rows.filter(F.col(key).isNotNull()).select(key, item).distinct()
    return one.join(exact_duplicates(rows, key, item).select(key, "canonical"), key).select(item, "canonical")


def conflicts(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, variants) of keys whose rows disagree in ``values``."""
    return rows.groupBy(key).agg(F.count_distinct(F.struct(*values)).alias("variants")).filter("variants > 1")


def safe_filename(c: Column) -> Column:
    """The last path part with unusual characters as low lines, 120 at most."""
    return F.left(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"[^A-Za-z0-9._-]+", "_"), F.lit(120))


def clean_title(c: Column, fallback: Column) -> Column:
    t = F.btrim(F.left(F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" .-_\t\r\n")), F.lit(180)))
    return F.coalesce(nullif_blank(t), fallback)


def display_name(c: Column) -> Column:
    """Without the suffix of a document."""
    return F.trim(F.regexp_replace(c, r"(?i)\.(?:pdf|pptx|docx|md|markdown|txt)$", ""))


def bounded(c: Column, n: int = 500) -> Column:
    """The text, cut to n characters with an ellipsis."""
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(n - 1))), F.lit("…")))


def by_rules(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The value of the first rule whose pattern matches."""
    out = None
    for pattern, value in rules:
        out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
    return out.otherwise(default)


def tags(c: Column, needles: dict[str, tuple[str, ...]]) -> Column:
    """The tags of which a needle stands in the text, in the order given."""
    low = F.lower(c)
    hit = lambda ws: low.rlike("|".join(ws))
    return F.array_compact(F.array(*[F.when(hit(ws), F.lit(t)) for t, ws in needles.items()]))


def mime_of(c: Column) -> Column:
    """Media type by suffix (fixed values)."""
    known = {"pdf": "application/pdf", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
    m = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def unsafe_path(c: Column) -> Column:
    """Absolute, empty, or with parts that leave the folder."""
    parts = F.split(F.regexp_replace(c, r"\\", "/"), "/")
    return c.startswith("/") | c.rlike(r"^[A-Za-z]:") | F.exists(parts, lambda p: p.isin("", ".", ".."))


def link_problem(c: Column) -> Column:
    """Why an address may not be followed: ``BLANK``, ``SCHEME``, ``HOST`` or ``CREDENTIALS``; null if it may."""
    return F.when(c.rlike(r"\s"), "BLANK").when(~c.rlike("^https?://"), "SCHEME").when(~c.rlike("^https?://[^/?#]"), "HOST").when(c.rlike("^https?://[^/?#]*@"), "CREDENTIALS")


def running_number(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Numbers from 0 inside a group; the group has to be bounded (a lecture, a module), never the whole table."""
    return rows.withColumn(name, (F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1).cast("long"))


def global_number(rows: DataFrame, order: list[str], name: str, *, buckets: int = 64) -> DataFrame:
    """Numbers from 0 over all rows without a window over all: range partitions, their sizes summed, then numbers inside each."""
    from lessonloom.runtime import materialize

    ranged = materialize(rows.repartitionByRange(buckets, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a partition
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return ranged.join(F.broadcast(start), "_p").withColumn(name, F.col("_start") + inside).drop("_p", "_start")


def group_number(rows: DataFrame, group: list[str], order: list[str], name: str, *, buckets: int = 64) -> DataFrame:
    """Numbers from 0 inside groups of any size: numbers over all rows less the group's first one."""
    g = global_number(rows, [*group, *order], "_n", buckets=buckets)
    first = g.groupBy(*group).agg(F.min("_n").alias("_f"))
    return g.join(first, group).withColumn(name, F.col("_n") - F.col("_f")).drop("_n", "_f")


def running_totals(rows: DataFrame, group: list[str], order: list[str], totals: dict[str, str], *, buckets: int = 64) -> DataFrame:
    """Each row with the sums of columns up to it in its group, however large the group: sums inside range partitions, and of those before."""
    from lessonloom.runtime import materialize

    ranged = materialize(rows.repartitionByRange(buckets, *group, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    upto = W.partitionBy("_p", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row a partition of a group
    sums = ranged.groupBy("_p", *group).agg(*[F.sum(c).alias(f"_s_{c}") for c in totals])
    start = sums.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g_{g}") for g in group], *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in totals])
    inside = ranged.select(*ranged.columns, *[F.sum(c).over(upto).alias(f"_i_{c}") for c in totals])
    j = inside.join(start, (inside["_p"] == start["_q"]) & _all([inside[g].eqNullSafe(start[f"_g_{g}"]) for g in group]))
    return j.select(*rows.columns, *[(F.col(f"_i_{c}") + F.col(f"_b_{c}")).alias(n) for c, n in totals.items()])


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def with_previous(rows: DataFrame, group: list[str], order: list[str], columns: list[str], *, buckets: int = 64) -> DataFrame:
    """Each row with ``columns`` of the row before it in its group as prev_*, null for the first: a join of numbers, no window over a group."""
    from lessonloom.runtime import materialize

    g = materialize(global_number(rows, [*group, *order], "_n", buckets=buckets), "numbered")
    before = g.select((F.col("_n") + 1).alias("_n"), *[F.col(c).alias(f"_g_{c}") for c in group], *[F.col(c).alias(f"prev_{c}") for c in columns])
    j = g.join(before, "_n", "left")
    same = None
    for c in group:
        same = F.col(c).eqNullSafe(F.col(f"_g_{c}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    for c in columns:
        j = j.withColumn(f"prev_{c}", F.when(same, F.col(f"prev_{c}")))
    return j.drop("_n", *[f"_g_{c}" for c in group])


def search(rows: DataFrame, fields: list[str], needle: str) -> DataFrame:
    """Rows in any of whose fields the needle stands, aside from case, marks and spacing; a blank needle finds all."""
    text = F.concat_ws("\n", *[F.array_join(f, "\n") if t.startswith("array") else F.col(f) for f in fields for n, t in rows.dtypes if n == f])
    return rows.filter(search_fold(text).contains(" ".join(_fold_needle(needle).split()))) if needle.strip() else rows


def _fold_needle(s: str) -> str:
    import unicodedata

    y = unicodedata.normalize("NFD", s).replace("đ", "d").replace("Đ", "D")
    return "".join(c for c in y if not unicodedata.category(c).startswith("M")).lower()


def answer_order(atom: Column, position: Column) -> Column:
    """The place (0 to 3) of the right answer of an atom's question: a permutation by hashes, then turned by another hash."""
    by = F.transform(F.array_sort(F.array(*[F.struct(F.sha2(F.concat(atom, F.lit(f":answer-order:{i}")).cast("binary"), 256).alias("h"), F.lit(i).alias("i")) for i in range(4)])), lambda x: x["i"])
    extra = F.conv(F.left(F.sha2(F.concat(atom, F.lit(":answer-extra")).cast("binary"), 256), F.lit(2)), 16, 10).cast("int") % 4
    at = F.when(position < 4, position).otherwise((extra + position - 4) % 4)
    return F.get(by, at)


def rotated(options: Column, right: Column, target: Column) -> Column:
    """Option texts turned so that the right one (index) stands at the target."""
    turn = F.pmod(right - target, F.lit(4))
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.get(options, (i + turn) % 4))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def similar_in_group(rows: DataFrame, group: str, item: str, words: str, threshold: float) -> DataFrame:
    """(group, a, b, score) of pairs in one bounded group (the questions of an atom) above the threshold.

    Pairs meet on a shared word of their prefix: the ceil((1 - t) * n) + 1 least hashed words of a text, one of which any
    pair above the threshold has in common, so no group is paired in full.
    """
    one = first_of(rows.select(group, item, words), [item], [group])
    least = F.slice(F.transform(F.array_sort(F.transform(words, lambda w: F.struct(F.xxhash64(w).alias("h"), w.alias("w")))), lambda x: x["w"]), F.lit(1), (F.size(words) - F.ceil(F.size(words) * threshold) + 1).cast("int"))
    at = one.withColumn("_w", F.explode(F.when(F.size(words) > 0, least)))
    a, b = at.select(group, F.col(item).alias("a"), F.col(words).alias("wa"), "_w"), at.select(group, F.col(item).alias("b"), F.col(words).alias("wb"), "_w")
    met = a.join(b, [group, "_w"]).filter("a < b").withColumn("score", jaccard(F.col("wa"), F.col("wb"))).filter(F.col("score") > threshold)
    return met.select(group, "a", "b", "score").distinct()
