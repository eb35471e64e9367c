"""Noise in text from scanned pages (problem 6).

Three kinds of noise are told apart per line: page furniture (running headers, footers, page numbers), words cut at a
line's end, and misrecognised words. Boosted trees classify the pairs a line forms with its neighbours (furniture) and
the pairs of a line and the next line of prose (joins). Words outside the word list ask for corrections: candidates
come from an inverted join on character q-grams of the words' shapes (letters that scanners mix up count as one), a
number's candidate is its reading as digits, and boosted trees rank them. A word is misread if its candidates together
explain it; one that no candidate explains (a right word the list lacks) is left alone.

All three models learn from artificial noise: the word list with misread shapes, words cut in two, and pages of at most
``SAMPLE`` records of the input into which furniture was planted. Everything else covers all records. Repeated headers
are counted per document over all its records; those of few records are known to the pages around them.

Null and blank texts have no noise and repair to themselves. Empty lines are never noise. Repeated rows count once.
Words of a text are compared in composed, lower-case form. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lessonloom.functions.text import letter_key, lines, nfc
from lessonloom.runtime import materialize, sampled, small

from .boosting import Boosted

#: Records into which furniture is planted for training.
SAMPLE = 1500
#: Chance, by a word's candidates together, from which it is misread.
MISREAD = 0.2
#: Records whose lines are classified at once.
AT_ONCE = 256
#: Records of a document in which a line has to return to count as repeated.
REPEATED = 3
#: A repeated line that one in so many of a document's records holds is known to all of them, so these are a bounded number.
OF_RECORDS = 20
#: Pages of a block; the other repeated lines are known to the blocks they stand in and to those beside them.
BLOCK = 64
#: Share of a word's q-grams that a candidate has to hold.
SHARED = 0.5
#: Letters up to which a candidate one edit away counts whatever it shares: one letter is most of a short word's q-grams.
SHORT_WORD = 3

HYPHENS = "-­‐‑–¬"
_CUT = re.compile(rf"([^\W_][^\s]*?)[{HYPHENS}]\s*$")
_DIGIT = r"[0-9OolI|SsBZz]"
_PAGE = re.compile(rf"^[\W_]*(?:(?:trang|page|tr|pg|p)\W{{0,3}})?{_DIGIT}{{1,4}}(?:\s*(?:/|of|-)\s*{_DIGIT}{{1,4}})?[\W_]*$", re.I)
_NUMBERED = re.compile(r"^\d+\s{2,}\S+(?: \S+)*$|\|\s*\d+$")
_LONE_WORD = re.compile(r"^[^\W\d_]+[.,;:!?]*$")
_EDGE = ".,:;!?()[]{}\"'“”‘’…*#<>«»"
_NUMBER = re.compile(r"^[+-]?\d+(?:[.,:/]\d+)*%?$")
_SYMBOLS = re.compile(r"^[^\w|]+$|^\|$")
#: Strokes that letters are made of, as scanners see them; letters that are taken for each other have one form (fixed values).
STROKES = str.maketrans({
    "m": "rrl", "n": "rl", "h": "ll", "u": "ll", "d": "cl", "w": "vv", "i": "l", "j": "l", "1": "l", "|": "l", "!": "l",
    "e": "c", "f": "t", "y": "v", "0": "o", "2": "z", "5": "s", "6": "b", "8": "b", "9": "g",
})
#: Letters taken for each other one by one (fixed values).
SINGLES = str.maketrans({"|": "l", "1": "l", "i": "l", "!": "l", "0": "o", "5": "s", "9": "g", "8": "b", "6": "b", "2": "z", "e": "c", "f": "t", "y": "v", "j": "l"})


#: Letters that stand for digits (fixed values).
_DIGITS = str.maketrans("OoQDlI|iZzSsBbgq", "0000111122558899")


def plain(word: str) -> str:
    """Lower case without marks and ligatures."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c)).replace("đ", "d")


def shape(word: str) -> str:
    """The word as a scanner sees it, in strokes."""
    return plain(word).translate(STROKES)


def grams(word: str) -> list[str]:
    """The character pairs of a word's shape, with its ends."""
    w = f"^{shape(word)}$"
    return sorted({w[k : k + 2] for k in range(len(w) - 1)})


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def tokens(line: str) -> list[tuple[int, int, str]]:
    """(start, end, word) of the words of a line, edge punctuation off."""
    out = []
    for m in re.finditer(r"\S+", line):
        w = m.group()
        left = len(w) - len(w.lstrip(_EDGE))
        core = w.strip(_EDGE)
        if core:
            out.append((m.start() + left, m.start() + left + len(core), core))
    return out


def right_word(word: str, known: frozenset[str]) -> bool:
    """Whether a word, number or sign may rightly stand in prose."""
    w = word.lower()
    if w in known or _NUMBER.match(w) or _SYMBOLS.match(w):
        return True
    parts = [p for p in re.split(r"[-–/=+*;·×<>≤≥(),.:_^]+|[…]", w) if p]
    return len(parts) > 1 and all(p in known or p.isdigit() for p in parts)


# --- furniture -------------------------------------------------------------------------------------------------


def key_of(line: str) -> str:
    return "".join(c for c in line.lower() if c.isalpha())


def triples(key: str) -> frozenset[str]:
    return frozenset(key[i : i + 3] for i in range(len(key) - 2))


def likeness(line: str, heads: list[tuple[str, frozenset[str]]]) -> float:
    """How much a line is one of a document's repeated lines: 2 if it is, or is the start of one before an ellipsis."""
    key = key_of(line)
    if len(key) < 6:
        return 0.0
    if any(key == h for h, _ in heads) or line.endswith("…") and any(h.startswith(key) for h, _ in heads):
        return 2.0
    near = [t for h, t in heads if abs(len(h) - len(key)) <= 0.3 * len(h)]
    own = triples(key) if near else frozenset()
    return max((len(own & t) / max(1, len(own | t)) for t in near), default=0.0)


def line_features(text: list[str], first: int, last: int, heads: list[str]) -> tuple[list[int], list[list[float]]]:
    """The lines that are not empty, and of each: the pairs it forms with the line before and behind it, its form and place."""
    known = [(h, triples(h)) for h in heads]
    at = [k for k, x in enumerate(text) if x.strip()]
    bare = [text[k].strip() for k in at]
    out = []
    for i, (k, line) in enumerate(zip(at, bare)):
        words = line.split()
        starts = next((c for c in line if c.isalpha()), "")
        before, after = bare[i - 1] if i else "", bare[i + 1] if i + 1 < len(bare) else ""
        short = len(words) <= 6
        page = short and bool(_PAGE.match(line)) and not (_LONE_WORD.match(line) and not line.isdigit())
        near = short and any(first - 1 <= int(x) <= last + 1 for x in re.findall(r"\d{1,4}", line))
        same = likeness(line, known) if starts.isupper() or page or short else 0.0
        out.append([
            float(page), float(near), same, float(line[-1] == "…"), float(text[k][0] == "\f"),
            float(bool(before) and before[-1] not in ".!?:…"), float(after[:1].islower()), float(line[-1] in ".;,:!?"),
            float(starts.isupper()), float(k == 0), float(k == len(text) - 1), float(len(words)), float(line.isupper()),
            float(sum("." in w for w in words) / max(1, len(words))), float(bool(_NUMBERED.search(line))),
            float(bool(before) and before[-1] not in ".!?:…" and after[:1].islower()), float(k + 1 < len(text) and not text[k + 1].strip()),
        ])
    return at, out


def planted(text: list[str], first: int, heads: list[str], title: str, r: np.random.Generator) -> tuple[list[str], list[int]]:
    """A record's prose with furniture put into it, and 1 for each planted line, 0 for each other.

    Lines that may be furniture already are taken out first. Some prose is made to look like furniture: lines that hold
    words of the title, and numbers alone at the end of a paragraph.
    """
    at, feats = line_features(text, first, first, heads)
    odd = {k for k, f in zip(at, feats) if f[0] or f[2] >= 0.3 or f[3] or f[4]}
    rows = [x for k, x in enumerate(text) if k not in odd]
    for k, x in enumerate(rows):
        if r.random() < 0.04 and title and len(x.split()) > 4:
            w, t = x.split(), title.split()
            n = int(r.integers(1, max(2, len(t))))
            rows[k] = " ".join([*t[:n], *w[n:]] if r.random() < 0.3 else [*w[: max(1, len(w) - n)], *t[:n]])
    labels = [0] * len(rows)
    for k in sorted((int(r.integers(0, len(rows) + 1)) for _ in range(int(r.integers(0, 2)))), reverse=True):
        if k and rows[k - 1].strip():
            rows.insert(k, f"{r.integers(2, 900)}." if r.random() < 0.8 else f"{r.random():.4f}")
            labels.insert(k, 0)
            rows.insert(k + 1, "")
            labels.insert(k + 1, 0)
    spots = [0] * int(r.random() < 0.5) + [len(rows)] * int(r.random() < 0.5) + [int(r.integers(0, len(rows) + 1)) for _ in range(int(r.integers(0, 3)))]
    for k in sorted(spots, reverse=True):
        page = first + int(r.integers(-1, 2)) if r.random() < 0.8 else int(r.integers(1, 400))
        for line in furniture_lines(max(1, page), title, r):
            rows.insert(k, line)
            labels.insert(k, 1)
    return rows, labels


def furniture_lines(page: int, title: str, r: np.random.Generator) -> list[str]:
    """A running title, a page number or both, as printers set and scanners misread them."""
    n = str(page)
    if r.random() < 0.1:
        n = "".join({"0": "O", "1": "l", "5": "S", "8": "B"}.get(c, c) for c in n)
    numbers = [n, f"— {n}", f"- {n} -", f"   {n}", f"[{n}]", f"Trang {n}", f"Page {n}", f"tr. {n}", f"p. {n}", f"{n}/{page + 20}", f"Trang {n} / {page + 20}", f"Page {n} of {page + 20}"]
    out = []
    if title and r.random() < 0.7:
        head = title
        if r.random() < 0.2:
            w = head.split()
            j = int(r.integers(len(w)))
            w[j] = noisy(w[j], r)
            head = " ".join(w)
        form = r.integers(6)
        head = head.upper() if form == 1 else f"{n}   {head}" if form == 2 else f"{head} | {n}" if form == 3 else head[: int(r.integers(8, max(9, len(head))))] + "…" if form == 4 else head
        out.append("\f" + head if r.random() < 0.15 else head)
    if not out or r.random() < 0.3:
        out.append(numbers[r.integers(len(numbers))])
    return out


def train_furniture(pages: list[tuple[str, int, list[str], str]]) -> Boosted | None:
    """Trained on (text, first page, repeated lines, title) of records with planted lines; none without any line."""
    r, x, y = np.random.default_rng(3), [], []
    for text, first, heads, title in pages:
        rows, labels = planted(unicodedata.normalize("NFC", text).split("\n"), first, heads, title, r)
        at, f = line_features(rows, first, first, heads)
        x += f
        y += [labels[k] for k in at]
    return Boosted(trees=40).fit(np.array(x), np.array(y)) if len(set(y)) == 2 else None


# --- joins -----------------------------------------------------------------------------------------------------


def pair_features(left: str, sep: str, right: str, known: frozenset[str], owned: frozenset[str], shapes: frozenset[str]) -> list[float]:
    """Of the last word before a line's hyphen and the first word of the next line of prose."""
    a, b = left.lower(), right.lower()
    tail = a.rpartition("-")[2]
    owns = [w for w in owned if w.startswith(a + "-")]
    return [
        float(a + b in known), float(f"{a}-{b}" in known), float(bool(owns)), max((1 - distance(f"{a}-{b}", w) / len(w) for w in owns), default=0.0),
        float(a in known), float(b in known), float(right[:1].islower()), float(sep == "-"), float(shape(a + b) in shapes), float(len(b)), float(len(tail)),
    ]


#: What scanners make of shapes: (right, misread) (fixed values).
MISREADINGS = (
    ("m", "rn"), ("n", "ri"), ("h", "li"), ("h", "b"), ("u", "ii"), ("d", "cl"), ("w", "vv"), ("l", "1"), ("l", "|"), ("l", "i"), ("i", "l"), ("i", "1"), ("o", "0"), ("s", "5"), ("g", "9"), ("e", "c"), ("t", "f"), ("b", "8"),
    ("b", "6"), ("z", "2"), ("y", "v"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("ơ", "o'"), ("ư", "u'"), ("0", "o"), ("0", "O"), ("1", "l"), ("1", "I"), ("5", "S"), ("8", "B"),
)
_MARKS = "\u0300\u0301\u0302\u0303\u0306\u0309\u0323"


def noisy(word: str, r: np.random.Generator) -> str:
    """A word with one or two shapes misread, or its marks lost, added or changed."""
    for _ in range(1 + int(r.random() < 0.25)):
        kind = r.random()
        vowels = [k for k, c in enumerate(word) if plain(c) in "aeiouy"]
        marks = [k for k, c in enumerate(word) if plain(c) != c]
        spots = [(k, a, b) for a, b in MISREADINGS for k in range(len(word)) if word.startswith(a, k)]
        if marks and kind < 0.25:
            word = plain(word)
        elif marks and kind < 0.4:
            k = marks[r.integers(len(marks))]
            word = word[:k] + plain(word[k]) + word[k + 1 :]
        elif vowels and kind < 0.55:
            k = vowels[r.integers(len(vowels))]
            word = word[:k] + unicodedata.normalize("NFC", plain(word[k]) + _MARKS[r.integers(len(_MARKS))]) + word[k + 1 :]
        elif spots:
            k, a, b = spots[r.integers(len(spots))]
            word = word.replace(a, b) if r.random() < 0.2 else word[:k] + b + word[k + len(a) :]
    return word


def train_joins(words: list[str]) -> Boosted:
    """Trained on words of the list: cut inside (1), or at a hyphen they own (0)."""
    known = frozenset(words)
    owned = frozenset(w for w in words if "-" in w)
    shapes = frozenset(shape(w) for w in words)
    r, x, y = np.random.default_rng(5), [], []
    long = [w for w in words if len(w) >= 4] or ["word"]
    for k in range(4000):
        if owned and k % 4 == 0:
            w = sorted(owned)[r.integers(len(owned))]
            cut = [i for i, c in enumerate(w) if c == "-"]
            i = cut[r.integers(len(cut))]
            a, b, label = w[:i], w[i + 1 :], 0
        else:
            w = long[r.integers(len(long))].replace("-", "") or "word"
            i = int(r.integers(1, max(2, len(w) - 1)))
            a, b, label = w[:i], w[i:], 1
        if r.random() < 0.25:
            b = noisy(b, r) if r.random() < 0.5 else b
            a = noisy(a, r) if label else a
        sep = "-" if r.random() < 0.5 else HYPHENS[r.integers(len(HYPHENS))]
        x.append(pair_features(a, sep, b, known, owned, shapes))
        y.append(label)
    return Boosted(trees=25).fit(np.array(x), np.array(y))


# --- corrections -----------------------------------------------------------------------------------------------


def forms(word: str) -> tuple[str, str, str, str]:
    """The lower-case word, without marks, in strokes, and with single letters that are taken for each other made one."""
    w = word.lower()
    p = plain(w).replace("'", "")
    return w, p, shape(w), p.translate(SINGLES)


def rank_features(a: tuple[str, str, str, str], b: tuple[str, str, str, str], apart: tuple[int, int, int], shared: float, frequency: float) -> list[float]:
    """Of a word's and a candidate's forms, and the edit distances of the words, their strokes and their single letters."""
    (w, pw, sw, ow), (c, pc, sc, oc) = a, b
    n, digits = max(len(w), len(c), 1), sum(x.isdigit() for x in w)
    return [
        apart[0] / n, apart[1] / max(len(sw), len(sc), 1), float(sw == sc), float(pw == pc), shared, float(len(w) - len(c)), float(w[:1] == c[:1]), float(w[-1:] == c[-1:]), float(np.log1p(frequency)), float(len(w)),
        float(ow == oc), apart[2] / n, float(apart[0]), float(c[:1].isdigit()), digits / max(1, len(w)), float(pw != w),
    ]


#: Ranks by the other fields alone, where there is nothing to learn from.
NO_RANKING = Boosted(trees=0).fit(np.zeros((2, 16)), np.array([0, 1]))


def train_ranking(words: list[str], frequency: dict[str, int]) -> Boosted:
    """Trained on words with artificial noise, and numbers, against their rivals by shared q-grams.

    Every sixth long word without marks is held out: the list does not know it, and no candidate explains it.
    """
    r, x, y = np.random.default_rng(9), [], []
    strange = [w for w in words if len(w) >= 5 and plain(w) == w][::6]
    out = frozenset(strange)
    listed = [w for w in words if w not in out] or words
    own = [grams(w) for w in listed]
    index: dict[str, list[int]] = {}
    for k, g in enumerate(own):
        for q in g:
            index.setdefault(q, []).append(k)
    at, sizes = {q: np.array(ks) for q, ks in index.items()}, np.array([len(g) for g in own])

    def ask(word: str, answer: str | None) -> None:
        g = grams(word)
        hits = [at[q] for q in g if q in at]
        counts = np.bincount(np.concatenate(hits), minlength=len(listed)) if hits else np.zeros(len(listed))
        near = np.argsort(-(counts / np.maximum(len(g), sizes)), kind="stable")[:8]
        read = number_of(word)
        rivals = [(listed[c], counts[c] / max(len(g), sizes[c]), frequency.get(listed[c], 0)) for c in near if counts[c]] + ([(read, 1.0, 0)] if read else [])
        a = forms(word)
        for rival, shared, often in rivals:
            b = forms(rival)
            x.append(rank_features(a, b, tuple(distance(a[k], b[k]) for k in (0, 2, 3)), shared, often))
            y.append(rival == answer)

    weight = np.array([1.0 + frequency.get(w, 0) for w in listed]) ** 0.5
    known = frozenset(words)
    for k in r.choice(len(listed), min(3000, 3 * len(listed)), p=weight / weight.sum()):
        bad = noisy(listed[k], r)
        if bad.lower() not in known:
            ask(bad, listed[k])
    for k in range(400):
        n = (f"{r.random():.4f}", f"{r.random() * 100:.2f}", str(r.integers(100, 999)))[k % 3]
        spots = [i for i, c in enumerate(n) if c in "0158"]
        if spots:
            i = spots[r.integers(len(spots))]
            options = {"0": "oO", "1": "lI|", "5": "S", "8": "B"}[n[i]]
            ask(n[:i] + options[r.integers(len(options))] + n[i + 1 :], n)
    for w in strange:
        ask(w, None)
    if len(set(y)) < 2:
        return NO_RANKING
    return Boosted(trees=60).fit(np.array(x), np.array(y))


def corrections(asked: DataFrame, vocabulary: DataFrame, model: Boosted) -> DataFrame:
    """(word, best, score, explained) for each different word asked for: the candidate that the trees rank first, and the
    chance that any of the candidates is right.

    ``asked`` has word; ``vocabulary`` (a fixed table of bounded size) has word, frequency. Both sides meet on their
    q-grams. Words of fewer letters than digits are numbers and have their reading as a candidate only.
    """
    spark = vocabulary.sparkSession
    grammed = materialize(vocabulary.select("word", "frequency", F.udf(grams, T.ArrayType(T.StringType()), useArrow=True)("word").alias("grams")), "vocabulary")
    # Both sides share half of the larger one's q-grams or don't meet, so the rarer half of each, by one order, has one in common.
    seen = grammed.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    order = {r.gram: r.n for r in seen.collect()}  # pairs of letters: a table of bounded size
    ranks = spark.sparkContext.broadcast(order)

    def rare(word: str) -> list[str]:
        own = sorted(grams(word), key=lambda q: (ranks.value.get(q, 0), q))
        return own if len(word) <= SHORT_WORD else own[: len(own) - math.ceil(SHARED * len(own)) + 1]

    read = F.udf(number_of, T.StringType(), useArrow=True)
    in_forms = F.udf(lambda w: None if w is None else list(forms(w)), T.ArrayType(T.StringType()), useArrow=True)
    pairs, rarest = F.udf(grams, T.ArrayType(T.StringType()), useArrow=True), F.udf(rare, T.ArrayType(T.StringType()), useArrow=True)

    def table(df: DataFrame, *more: str) -> DataFrame:
        return materialize(df.select(F.monotonically_increasing_id().alias("id"), "word", in_forms("word").alias("forms"), pairs("word").alias("grams"), rarest("word").alias("rare"), *more), "words")

    digits, letters = F.regexp_count("word", F.lit(r"\d")), F.regexp_count("word", F.lit(r"\p{L}"))
    strange, listed = table(asked.select("word").distinct().repartition(spark.sparkContext.defaultParallelism, "word")), table(grammed, "frequency")
    left = strange.filter(digits <= letters).select(F.col("id").alias("w"), F.size("grams").alias("n"), F.length("word").alias("nl"), F.explode("rare").alias("gram"))
    right = listed.select(F.col("id").alias("c"), F.size("grams").alias("m"), F.length("word").alias("ml"), F.explode("rare").alias("gram"))
    near = (F.least("n", "m") >= SHARED * F.greatest("n", "m")) | (F.greatest("nl", "ml") <= SHORT_WORD)
    met = left.join(small(materialize(right, "grams")), "gram").filter(near).select("w", "c").distinct()
    met = met.join(strange.select(F.col("id").alias("w"), "word", F.col("forms").alias("a"), F.col("grams").alias("g")), "w").join(small(listed.select(F.col("id").alias("c"), F.col("word").alias("candidate"), F.col("forms").alias("b"), F.col("grams").alias("h"), "frequency"), row_bytes=512), "c")
    met = met.withColumn("shared", F.size(F.array_intersect("g", "h")) / F.greatest(F.size("g"), F.size("h")))
    short = (F.greatest(F.length("word"), F.length("candidate")) <= SHORT_WORD) & (F.levenshtein("word", "candidate") <= 1)
    met = met.filter((F.col("shared") >= SHARED) | short).select("word", "candidate", "a", "b", "shared", "frequency")
    numbers = strange.filter(digits > 0).withColumn("candidate", read("word")).filter("candidate IS NOT NULL").select("word", "candidate", F.col("forms").alias("a"), in_forms("candidate").alias("b"), F.lit(1.0).alias("shared"), F.lit(0).cast("long").alias("frequency"))
    met = met.unionByName(numbers)
    apart = [F.levenshtein(F.col("a")[k], F.col("b")[k]) for k in (0, 2, 3)]

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series, d0: pd.Series, d2: pd.Series, d3: pd.Series, shared: pd.Series, frequency: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.array([rank_features(x, y, (p, q, r), s, f) for x, y, p, q, r, s, f in zip(a, b, d0, d2, d3, shared, frequency)])))

    ranked = met.withColumn("score", score("a", "b", *apart, "shared", "frequency"))
    best = ranked.groupBy("word").agg(F.max(F.struct("score", "frequency", "candidate")).alias("b"), F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.9999)))).alias("none"))
    return best.select("word", F.col("b.candidate").alias("best"), F.col("b.score").alias("score"), (1 - F.exp("none")).alias("explained"))


# --- operator --------------------------------------------------------------------------------------------------


def block_of(first: Column) -> Column:
    return F.floor(F.coalesce(first, F.lit(0)) / BLOCK).cast("long")


def repeated_heads(records: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Letters of the lines that begin with a capital or digit and return in several records of a document.

    (doc, heads) of those in a good share of its records, and (doc, block, near) of the others, if there are any.
    """
    at = records.select("doc", "rec", block_of(F.col("first")).alias("block"), F.explode(lines(nfc(F.col("text")))).alias("line"))
    at = at.filter(F.col("line").rlike(r"^[\f\s]*[\p{Lu}\d]") & ~F.trim("line").rlike(r"[.,;:!?]$"))
    key = letter_key(F.col("line"))
    keyed = at.select("doc", "rec", "block", key.alias("key")).filter(F.length("key").between(6, 120))
    often = keyed.groupBy("doc", "key").agg(F.count_distinct("rec").alias("n")).filter(F.col("n") >= REPEATED)
    sizes = records.groupBy("doc").agg(F.count(F.lit(1)).alias("records"))
    often = materialize(often.join(sizes, "doc").select("doc", "key", (F.col("n") * OF_RECORDS >= F.col("records")).alias("wide")), "often")
    wide = often.filter("wide").groupBy("doc").agg(F.collect_set("key").alias("heads"))
    narrow = often.filter("NOT wide").select("doc", "key")
    if narrow.isEmpty():
        return wide, None
    stands = keyed.join(narrow, ["doc", "key"]).select("doc", "key", F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1)).alias("block"))
    return wide, stands.groupBy("doc", "block").agg(F.collect_set("key").alias("near"))


_EVENTS = T.StructType([T.StructField(n, t) for n, t in (("rec", T.StringType()), ("line_no", T.LongType()), ("kind", T.StringType()), ("word", T.StringType()), ("next_line", T.LongType()))])


class Reader:
    """Finds the events of records: ``running``, ``cut`` (word joined), ``own`` (hyphen kept), ``unknown`` words."""

    def __init__(self, words: list[str], page: Boosted | None, joins: Boosted):
        self.known, self.owned = frozenset(words), frozenset(w for w in words if "-" in w)
        self.shapes = frozenset(shape(w) for w in words)
        self.page, self.joins = page, joins
        self.right: dict[str, bool] = {}

    def _strange(self, line: str) -> list[tuple[int, str]]:
        """(start, word) of the words of a line that may not rightly stand in prose."""
        right = self.right
        if len(right) > 500_000:
            right.clear()
        odd = False
        for raw in line.split():
            ok = right.get(raw)
            if ok is None:
                ok = right[raw] = all(right_word(w, self.known) for _, _, w in tokens(raw))
            odd |= not ok
        return [(a, w) for a, _, w in tokens(line) if not right_word(w, self.known)] if odd else []

    def read(self, records: list[tuple[str, int, int, list[str], str]]) -> Iterator[tuple[str, int, str, str | None, int | None]]:
        """(rec, line from 0, kind, word, next line) of all records; the lines, then the line pairs, are classified together."""
        texts = [unicodedata.normalize("NFC", text or "").split("\n") for *_, text in records]
        found = [line_features(rows, first, last, heads or []) for rows, (_, first, last, heads, _) in zip(texts, records)]
        feats = [f for _, fs in found for f in fs]
        chance = iter(self.page.predict(np.array(feats)) if self.page and feats else np.zeros(len(feats)))
        prose = []
        for (rec, *_), (at, _) in zip(records, found):
            run = [next(chance) > 0.5 for _ in at]
            prose.append([k for k, x in zip(at, run) if not x])
            for k, x in zip(at, run):
                if x:
                    yield rec, k, "running", None, None
        skip: dict[tuple[int, int], set[int]] = {}
        pairs, asked = [], []
        for i, (rows, own) in enumerate(zip(texts, prose)):
            for k, n in zip(own, own[1:]):
                m = _CUT.search(rows[k])
                after = tokens(rows[n])[:1] if m else None
                if not after:
                    continue
                left, right = m.group(1).lstrip(_EDGE), after[0][2]
                if not left or not left[-1].isalpha() or not right[:1].isalnum() and right[:1] != "|":
                    continue
                pairs.append((i, k, n, left, right))
                asked.append(pair_features(left, rows[k].rstrip()[-1], right, self.known, self.owned, self.shapes))
                skip.setdefault((i, k), set()).add(m.start(1) + len(m.group(1)) - len(left))
                skip.setdefault((i, n), set()).add(after[0][0])
        for (i, k, n, left, right), p in zip(pairs, self.joins.predict(np.array(asked)) if asked else ()):
            cut = p > 0.5
            yield records[i][0], k, "cut" if cut else "own", (left + ("" if cut else "-") + right).lower(), n
        for i, (rows, own) in enumerate(zip(texts, prose)):
            for k in own:
                for a, w in self._strange(rows[k]):
                    if a not in skip.get((i, k), ()):
                        yield records[i][0], k, "unknown", w.lower(), None


def events(records: DataFrame, word_list: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Events of all records, the records with their documents' repeated lines, and the word list.

    ``records`` has rec, doc, first, last, title, text. The word list is a fixed table of at most 200,000 words.
    """
    known = word_list.select(F.lower(nfc(F.col("word"))).alias("word")).filter("word <> ''").distinct().limit(200_001).collect()
    words = sorted(r.word for r in known)
    if len(words) > 200_000:
        raise ValueError("the word list is meant as a fixed table")
    one = records.filter("rec IS NOT NULL").dropDuplicates(["rec"])
    wide, narrow = repeated_heads(one)
    heads = materialize(wide, "heads")
    if narrow is None:
        one = one.withColumn("near", F.array().cast("array<string>"))
    else:
        narrow = materialize(narrow, "near")
        one = one.withColumn("block", block_of(F.col("first"))).join(small(narrow, row_bytes=4096), ["doc", "block"], "left")
    own = F.array_compact(F.array(F.when(F.length("title") > 0, letter_key(nfc(F.col("title"))))))
    none = F.array().cast("array<string>")
    one = one.join(small(heads, row_bytes=256), "doc", "left").select("rec", F.coalesce("first", F.lit(0)).alias("first"), F.coalesce("last", "first", F.lit(0)).alias("last"), F.array_union(F.array_union(F.coalesce("heads", none), F.coalesce("near", none)), F.coalesce(own, none)).alias("heads"), "title", "text")
    one = materialize(one, "pages")
    sample = sampled(one, "rec", SAMPLE).collect()
    page = train_furniture(sorted((r.text, r.first, list(r.heads), unicodedata.normalize("NFC", r.title or "").strip()) for r in sample if r.text and r.text.strip()))
    reader = one.sparkSession.sparkContext.broadcast((words, page, train_joins(words)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Reader(*reader.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                rows = list(zip(*(c.to_pylist() for c in batch.slice(lo, AT_ONCE).columns)))
                out = [(rec, k + 1, kind, word, None if n is None else n + 1) for rec, k, kind, word, n in own.read(rows)]
                columns = zip(*out) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=_EVENTS.fieldNames())

    found = one.select("rec", "first", "last", "heads", "text").mapInArrow(read, _EVENTS)
    return materialize(found, "events"), one, words


def _corrected(asked: DataFrame, one: DataFrame, words: list[str]) -> DataFrame:
    """Corrections of the words asked for that the list does not hold."""
    spark = asked.sparkSession
    listed = spark.createDataFrame([(w,) for w in words], "word string")
    spoken = one.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}][\p{L}-]*"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))
    vocabulary = materialize(listed.join(spoken, "word", "left").select("word", F.coalesce("frequency", F.lit(0)).alias("frequency")), "spoken")
    frequency = {r.word: r.frequency for r in vocabulary.collect()}  # as many rows as the word list
    model = train_ranking(words, frequency) if words else NO_RANKING
    return corrections(asked.select("word").distinct().join(F.broadcast(listed), "word", "left_anti"), vocabulary, model)


def noise_lines(records: DataFrame, word_list: DataFrame) -> DataFrame:
    """(record_id, line_no, noise): running_line, split_word or misread, each once a line."""
    found, one, words = events(records, word_list)
    odd = found.filter("kind = 'unknown'")
    wrong = _corrected(odd, one, words).filter(F.col("explained") >= MISREAD).select("word")
    misread = odd.join(wrong, "word", "left_semi").select("rec", "line_no", F.lit("misread").alias("noise"))
    others = found.filter("kind IN ('running', 'cut')").select("rec", "line_no", F.when(F.col("kind") == "cut", "split_word").otherwise("running_line").alias("noise"))
    return others.unionByName(misread).select(F.col("rec").alias("record_id"), "line_no", "noise").distinct()


def repair(text: str | None, marks: list[tuple[int, str, str | None, int | None, str | None]]) -> str | None:
    """The text without furniture, words joined and corrected, wrapped lines as paragraphs; ``marks``: (line, kind, word, next, best)."""
    if text is None or not text.strip():
        return text
    rows = [x.strip("\f") for x in unicodedata.normalize("NFC", text).split("\n")]
    gone = {k for k, kind, *_ in marks if kind == "running"}
    fixes = {(k, w): best for k, kind, w, _, best in marks if kind == "unknown"}
    tails = {k: (kind, w, n, best) for k, kind, w, n, best in marks if kind in ("cut", "own")}
    heads: dict[int, str] = {}
    parts: list[list[str]] = [[]]
    for k, x in enumerate(rows, 1):
        if k in gone:
            continue
        if not x.strip():
            parts.append([])
            continue
        out, at = [], 0
        for a, b, w in tokens(x):
            best = fixes.get((k, w.lower()))
            if best:
                out += [x[at:a], _cased(w, best)]
                at = b
        line = "".join([*out, x[at:]])
        if k in heads:
            first = tokens(line)
            if first:
                line = heads.pop(k) + line[first[0][1] :]
        if k in tails:
            kind, w, n, best = tails[k]
            m = _CUT.search(line)
            if m:
                lead = m.group(1).lstrip(_EDGE)
                keep = line[: m.start(1) + len(m.group(1)) - len(lead)]
                heads[n] = keep + _cased(lead, best or w)
                line = ""
        if line:
            parts[-1].append(" ".join(line.split()))
    return "\n\n".join(" ".join(p) for p in parts if p)


def number_of(word: str) -> str | None:
    """A number with misread digits, read as one; none if it isn't."""
    if not any(c.isdigit() for c in word) or len(re.findall(r"[^\W\d_]", word)) > 2:
        return None
    n = word.translate(_DIGITS)
    return n if _NUMBER.match(n) else None


def _cased(old: str, new: str) -> str:
    if len(old) > 1 and old.isupper():
        return new.upper()
    return new[:1].upper() + new[1:] if old[:1].isupper() else new


def repaired_texts(records: DataFrame, word_list: DataFrame) -> DataFrame:
    """(record_id, repaired_text, fixes) of every record."""
    found, one, words = events(records, word_list)
    asked = found.filter("kind IN ('unknown', 'cut', 'own')").select("word")
    fixes = _corrected(asked, one, words).filter(F.col("explained") >= MISREAD)
    marks = found.join(fixes, "word", "left").groupBy("rec").agg(F.collect_list(F.struct("line_no", "kind", F.col("word"), "next_line", "best")).alias("marks"))
    apply = F.udf(lambda text, m: repair(text, [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in m or []]), T.StringType(), useArrow=True)
    return one.join(marks, "rec", "left").select(F.col("rec").alias("record_id"), apply("text", "marks").alias("repaired_text"), F.coalesce(F.size("marks"), F.lit(0)).alias("fixes"))
