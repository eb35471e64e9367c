"""Lines repeated across the documents of one source (problem 1).

Each line's documents are kept as compressed bitmaps per source: a document has an ordinal inside one of its source's
containers, and a bitmap holds only those of its words of 64 ordinals that are not zero, one row of eight bytes each, so
a line of five documents costs five words at most and a dense one an eighth of a byte a document. The bitmaps of
variants (lines that differ in digits, punctuation, case or spacing) are united word by word, cardinalities are exact
bit counts, and lines are deleted by looking their document's bit up. Nothing in it is larger than a word, and a hot
line's words are spread over all tasks.

Nulls: rows without source, document, id or text have no lines (a text of null still counts its document). Empty
texts have one empty line, which is never a case. Repeated rows change nothing. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lessonloom.functions.hashing import key128
from lessonloom.functions.text import lines, nfc
from lessonloom.runtime import materialize, small

#: Documents aimed at per container of a source; ordinals are given inside one, so no window holds a whole source.
FILL = 1 << 14
#: Ordinals in a word of a bitmap.
WORD = 64


def _lines(rows: DataFrame, *, stored: bool = False) -> DataFrame:
    """(source, doc, rec, line_no, k1, k2) of lines with three words; with ``stored`` also the line as it stands.

    Letters are picked out once per text, not per line; what remains for a line is counting and dropping blanks.
    """
    text = rows.withColumn("text", nfc(F.col("text")))
    text = text.withColumn("letters", F.regexp_replace(F.lower("text"), r"[^\p{L}\n]+", " "))
    cut = lines(F.col("letters"))
    each = F.arrays_zip(cut.alias("letters"), lines(F.col("text")).alias("line")) if stored else F.transform(cut, lambda x: F.struct(x.alias("letters")))
    at = text.select("source", "doc", "rec", F.posexplode(each).alias("pos", "l")).withColumn("words", F.trim("l.letters"))
    key = F.replace("words", F.lit(" "))
    at = at.filter(F.length("words") - F.length(key) >= 2)
    k1, k2 = key128(key)
    return at.select("source", "doc", "rec", (F.col("pos") + 1).cast("bigint").alias("line_no"), k1.alias("k1"), k2.alias("k2"), *([F.col("l.line").alias("line")] if stored else []))


def document_ordinals(docs: DataFrame) -> DataFrame:
    """(source, doc, container, word, bit): the place of each document in its source's bitmaps, dense inside a container.

    ``docs`` has source, doc, documents (how many the source has); a source has as many containers as it needs.
    """
    own = docs.withColumn("container", F.pmod(F.xxhash64("doc"), F.greatest(F.lit(1), F.ceil(F.col("documents") / FILL))).cast("int"))
    ordinal = F.row_number().over(W.partitionBy("source", "container").orderBy("doc")) - 1
    own = own.withColumn("ordinal", ordinal)
    return own.select("source", "doc", "container", F.floor(F.col("ordinal") / WORD).cast("int").alias("word"), (F.col("ordinal") % WORD).cast("int").alias("bit"))


def line_bitmaps(occurrences: DataFrame) -> DataFrame:
    """(source, k1, k2, container, word, bits): the words that are not zero of each line's bitmap, all its variants united.

    ``occurrences`` has source, k1, k2, variant, container, word, bit. One shuffle serves the bitmaps of the variants and their union.
    """
    at = occurrences.repartition("source", "k1", "k2", "container", "word")
    bit = F.expr("shiftleft(1L, bit)")
    variants = at.groupBy("source", "k1", "k2", "variant", "container", "word").agg(F.bit_or(bit).alias("bits"))
    return variants.groupBy("source", "k1", "k2", "container", "word").agg(F.bit_or("bits").alias("bits"))


def repeated_lines(rows: DataFrame, *, source: str = "source_site", document: str = "document_id", record: str = "chunk_id", text: str = "normalized_text", min_documents: int = 5, min_share: int = 50) -> DataFrame:
    """(source, record, line_no) of every line that stands in ``min_documents`` documents and one in ``min_share`` of its source."""
    rows = rows.select(F.col(source).alias("source"), F.col(document).alias("doc"), F.col(record).alias("rec"), F.col(text).alias("text")).filter("source IS NOT NULL AND doc IS NOT NULL")
    own = rows.filter("rec IS NOT NULL AND text IS NOT NULL")
    # A line of n documents has n rows at least: this count only spares the bitmaps of lines that cannot be cases.
    often = materialize(_lines(own).groupBy("source", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents).drop("n"), "often")
    docs = materialize(rows.select("source", "doc").distinct(), "docs")
    total = materialize(docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents")), "sources")
    places = document_ordinals(docs.join(small(total), "source"))
    found = _lines(own, stored=True).join(small(often), ["source", "k1", "k2"]).select("source", "doc", "rec", "line_no", "k1", "k2", F.xxhash64("line").alias("variant"))
    found = materialize(found.join(places, ["source", "doc"]), "occurrences")
    bitmaps = materialize(line_bitmaps(found), "bitmaps")
    exact = bitmaps.groupBy("source", "k1", "k2").agg(F.sum(F.bit_count("bits")).alias("n"))
    cases = exact.join(small(total), "source").filter((F.col("n") >= min_documents) & (F.col("n") * min_share >= F.col("documents")))
    kept = bitmaps.join(cases.select("source", "k1", "k2"), ["source", "k1", "k2"])
    hit = found.join(kept, ["source", "k1", "k2", "container", "word"]).filter(F.expr("shiftright(bits, bit) & 1L = 1L"))
    return hit.select("source", "rec", "line_no").distinct()


def without_lines(rows: DataFrame, found: DataFrame, *, record: str = "chunk_id", text: str = "normalized_text") -> DataFrame:
    """(record, cleaned_text, removed_lines): each record once, its found lines taken out and the rest as stored."""
    own = rows.select(F.col(record).alias("rec"), F.col(text).alias("text")).filter("rec IS NOT NULL").dropDuplicates(["rec"])
    gone = found.groupBy("rec").agg(F.collect_set("line_no").alias("gone"))
    kept = F.filter(lines(F.col("text")), lambda x, i: ~F.coalesce(F.array_contains(F.col("gone"), (i + 1).cast("bigint")), F.lit(False)))
    return own.join(gone, "rec", "left").select(F.col("rec").alias(record), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("cleaned_text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines"))
