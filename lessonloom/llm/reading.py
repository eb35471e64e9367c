"""Reading level of each document (problem 9): a familiar-word formula.

Level = a + b * share of words outside a high-frequency list + c * log(average sentence length). The list holds, per
language, the words that stand in at least ``list_share`` of the corpus's documents; the share bounds its size, as a
document has a bounded number of different words. As in formulas of this kind, proper names (capitalised inside a
sentence) count as familiar. The coefficients are fitted on labelled documents (ordinary least squares on at most
``fit_rows`` labels, mean of a document's labels), the cuts between levels are those with the fewest errors there.

Sentences end at a stop before a capital, at empty lines, before list items and, where a document's lines aren't
wrapped, at each line end (stops are often missing). Headings, tables' pipes, mark-up and source lines don't count.

Null and blank texts and texts under ``min_words`` get no level. Repeated ids are read once; null ids are dropped.
Without labels of two levels at least, fixed coefficients and cuts are used in which both terms count.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.runtime import materialize, sampled

#: Constant, weight of unfamiliar words and of sentence length where there are no labels to fit them to.
UNFITTED = (-1.5, 4.0, 1.2)

WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_LINE = re.compile(r"\n[ \t]*([^\W\d_])")
_BLOCK = re.compile(r"\n\s*\n|\n(?=\s*(?:[-*•#]|\d+[.)])\s)")
_STOP = re.compile(r"[.!?…]+[\"')\]]*\s+(?=[\"'(\[]*([^\W\d_]))")
_SKIP = re.compile(r"(?m)^\s*(?:#{1,6}\s.*|(?:source|nguồn|url|http)\b.*|\|?\s*[-|: ]+\|?\s*)$", re.I)
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|&[a-z]{2,6};|https?://\S+")
_SCHEMA = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("n_prose", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("n_sentences", T.IntegerType()),
    T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType())),
])


def sentences(text: str) -> list[str]:
    """The sentences of a text."""
    text = _SKIP.sub("\n", _MARKUP.sub(" ", text))
    starts = [c.islower() for c in _LINE.findall(text)]
    wrapped = sum(starts) >= 0.3 * len(starts)
    out = []
    for block in _BLOCK.split(text):
        for part in [block] if wrapped else block.split("\n"):
            last = 0
            for m in _STOP.finditer(part):
                if m.group(1).isupper():
                    out.append(part[last : m.end()])
                    last = m.end()
            out.append(part[last:])
    return out


def measure(text: str | None) -> tuple[str, int, int, int, list[str], list[int]]:
    """(language by its letters, words in sentences, words in all, sentences, different words that aren't names, their counts)."""
    found = [w for w in (WORD.findall(s) for s in sentences(unicodedata.normalize("NFC", text or ""))) if w]
    n = sum(map(len, found))  # of the sentences; headings and source lines are out
    upper = sum(w[0].isupper() for s in found for w in s)
    shout = upper > 0.6 * n
    words = Counter(w.lower() for s in found for k, w in enumerate(s) if shout or not k or not w[0].isupper())
    letters = sum(map(len, words.elements()))
    lang = "vi" if sum(c > "\x7f" for w, k in words.items() for c in w * k) >= 0.05 * max(1, letters) else "en"
    return lang, n, len((text or "").split()), len(found), list(words), list(words.values())


@F.pandas_udf(_SCHEMA)
def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([measure(x) for x in s], columns=["lang", "n_prose", "n_words", "n_sentences", "words", "counts"])


def _scores(docs: DataFrame, *, list_share: float) -> DataFrame:
    """(doc_id, source, lang, n_words, sentence_words, unfamiliar) over all documents."""
    rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "source", "lang", "text").dropDuplicates(["doc_id"])
    read = materialize(rows.withColumn("m", _measured("text")).select("doc_id", "source", F.col("lang").alias("stated_lang"), "m.*"), "reading")
    per_lang = read.filter("n_prose > 0").groupBy("lang").agg(F.count(F.lit(1)).alias("documents"))
    frequency = read.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df"))
    # At most (average number of different words) / list_share words pass, whatever the corpus's size.
    familiar = frequency.join(per_lang, "lang").filter(F.col("df") >= F.col("documents") * list_share).select("lang", "word", F.lit(True).alias("known"))
    each = read.select("doc_id", "lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("doc_id", "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("k"))
    unknown = each.join(F.broadcast(familiar), ["lang", "word"], "left_anti").groupBy("doc_id").agg(F.sum("k").alias("unknown"))
    total = F.greatest(F.lit(1), F.aggregate("counts", F.lit(0), lambda a, b: a + b))
    out = read.join(unknown, "doc_id", "left")
    return out.select("doc_id", "source", "stated_lang", "lang", "n_words", (F.col("n_prose") / F.greatest(F.lit(1), "n_sentences")).alias("sentence_words"), (F.coalesce("unknown", F.lit(0)) / total).alias("unfamiliar"))


def fit(labelled: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """(coefficients, cuts between the levels 1 to 5) from (unfamiliar, sentence_words, level)."""
    if len({round(y) for *_, y in labelled}) < 2:
        return list(UNFITTED), [1.5, 2.5, 3.5, 4.5]
    x = np.array([(1.0, u, np.log(max(1.0, s))) for u, s, _ in labelled])
    y = np.array([y for *_, y in labelled])
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    p = x @ b
    cuts = []
    for k in (1.5, 2.5, 3.5, 4.5):
        at = np.unique(np.concatenate([p[(p > k - 1) & (p < k + 1)], [k]]))
        at = (at[1:] + at[:-1]) / 2 if len(at) > 1 else at
        wrong = np.array([((p >= c) != (y >= k)).sum() for c in at])
        best = at[wrong == wrong.min()]
        cuts.append(float(best[np.abs(best - np.median(best)).argmin()]))
    return [float(v) for v in b], sorted(cuts)


def reading_levels(docs: DataFrame, labels: DataFrame, *, list_share: float = 0.2, min_words: int = 25, fit_rows: int = 20_000) -> DataFrame:
    """(doc_id, source, lang, n_words, sentence_words, unfamiliar, score, reading_level); level null under ``min_words``.

    ``fit_rows`` bounds the labels used for the fit (those of the smallest hashes of doc_id).
    """
    scores = materialize(_scores(docs, list_share=list_share), "scores")
    mean = labels.filter("doc_id IS NOT NULL AND reading_level BETWEEN 1 AND 5").groupBy("doc_id").agg(F.avg("reading_level").alias("level"))
    known = materialize(scores.filter(F.col("n_words") >= min_words).join(mean, "doc_id").select("doc_id", "unfamiliar", "sentence_words", "level"), "labelled")
    b, cuts = fit([tuple(r) for r in sampled(known, "doc_id", fit_rows).select("unfamiliar", "sentence_words", "level").collect()])
    score = F.lit(b[0]) + F.lit(b[1]) * F.col("unfamiliar") + F.lit(b[2]) * F.log(F.greatest(F.lit(1.0), "sentence_words"))
    level = F.lit(1) + sum(((F.col("score") >= c).cast("int") for c in cuts), F.lit(0))
    return scores.withColumn("score", score).withColumn("reading_level", F.when(F.col("n_words") >= min_words, level)).select("doc_id", "source", F.col("stated_lang").alias("lang"), "n_words", "sentence_words", "unfamiliar", "score", "reading_level")


def profile(levels: DataFrame) -> DataFrame:
    """Documents per source, lang and level with their mean score; documents without a level have level null."""
    return levels.groupBy("source", "lang", "reading_level").agg(F.count(F.lit(1)).alias("documents"), F.avg("score").alias("mean_score"), F.avg("sentence_words").alias("mean_sentence_words"), F.avg("unfamiliar").alias("mean_unfamiliar"))
