"""Near-duplicate records with small edits (problem 2): multi-index hashing.

Every text gets a fingerprint of min-wise symbols, cut into segments. In each segment the Hamming ball of radius one
is enumerated (the segment with each of its symbols left open), so two texts meet in a table of that segment if they
differ there in one symbol at most. Pairs that met are verified by the complete distance of a second signature, by a bitmap
of the words' parities, which loses no pair, and then by the exact share of common words. Buckets of more than ``SIFTED``
texts are sent signatures and bitmaps, so what is shuffled follows their texts, not the pairs that met by chance.

Two fingerprints serve two lengths, and overlap so that no pair falls between them (a pair's sizes differ by
30 % at most): short texts take single words, long ones runs of three, which tell them apart well, and single words in
longer segments, which reordering does not change. Features that stand in many texts (templates, site lines) weigh
less; they are found by counting, over all classes, in a table of fixed size, so what is broadcast does not grow with
the data. Texts of mostly frequent runs, edited copies of what very many copy, take a third one without weights. The number of symbols in a segment grows with the logarithm of the number of texts, and the number of
segments with it, which holds chance meetings down and recall up.

Crowds have an exact way of their own. A table's bucket of more than ``BUCKET`` texts (copies of one template) is not
paired off; its pairs are searched by their rarest words in the bucket: two texts with the share of common words must
have one of these in common, so nothing of a bucket is missed and texts that share the template only do not meet.
Texts that stand in many such buckets (``CROWDED``) are not searched bucket by bucket: those of one bucket form a group,
joined with the groups of copies found so far, and each group of more than ``FEW`` texts is searched once. The other
texts of their buckets are guests of the group: compared with its texts there, and with each other in their buckets.

Texts of one word set are one class: only its representative is compared; members are joined to it afterwards. Texts
that are null or have under ``min_words`` different words have no pairs. Null ids are dropped, repeated rows are one.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lessonloom.runtime import materialize, small

WORD = re.compile(r"[^\W_]+")
CELLS = 1 << 17
#: Words up to which a text takes the short fingerprint, and from which it takes the long one (0.7 * 96 > 64).
SHORT_TO, LONG_FROM = 96, 65
#: (share of texts from which a feature is frequent, weight of frequent ones, of others, symbols a segment, segments)
SHORT, LONG, LONG_WORDS, DENSE = (0.05, 1.0, 3.0, 6, 16), (0.01, 0.1, 1.0, 4, 14), (0.05, 0.1, 1.0, 8, 6), (0.05, 1.0, 1.0, 4, 8)
#: Share of frequent runs from which a text takes the dense fingerprint too: it is a copy of a text that very many copy.
DENSE_FROM = 0.6
#: Share of equal symbols, for words and runs, at which more symbols a segment must not meet less often.
HELD = (0.44, 0.28)
#: Texts in which a feature has to stand at least to be frequent: a few copies of one text don't make theirs frequent.
FREQUENT = 50
#: Texts up to which these segments serve; 16 times as many take one symbol more and the segments that hold recall.
BASE_TEXTS = 400_000
#: Symbols of the signature (2 bits each) by which complete distances are verified.
SIGNATURE = 64
#: Bits of the bitmap of a text's words, each flipped by every word that falls on it.
BITS = 512
#: Texts of one key up to which they are paired off: half as many comparisons a text, made in place, cost less than its words sent.
BUCKET = 64
#: Texts of one key up to which its pairs are sent to their signatures; those of more are sent to the key with the bitmaps.
SIFTED = 8
#: Keys of a text in crowded buckets from which it is searched once in a group, not in each of them.
CROWDED = 16
#: One in so many texts shows which keys are very hot, namely those of so many of them.
SAMPLED, OFTEN = 64, 8
#: Texts of a group up to which all its pairs are compared (at most 2.5 a text).
FEW = 6

_U = np.uint64
_HASH: dict[str, int] = {}


def _seeds(name: int, n: int, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of ``n`` hash functions."""
    r = np.random.default_rng(1000 + name)
    top = np.iinfo(kind).max
    return r.integers(0, top, n, dtype=kind) | kind(1), r.integers(0, top, n, dtype=kind)


def _folded(x: np.ndarray) -> np.ndarray:
    """32 bits of 64; hashing 32-bit values is vectorised."""
    return ((x >> _U(32)) ^ (x & _U(0xFFFFFFFF))).astype(np.uint32)


def words_of(text: str) -> np.ndarray:
    """Hashes of the words of a text in order."""
    import xxhash

    if len(_HASH) > 1_000_000:
        _HASH.clear()
    found = WORD.findall(unicodedata.normalize("NFC", text).lower())
    for w in found:
        if w not in _HASH:
            _HASH[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_HASH.__getitem__, found), np.uint64, len(found))


def each_run(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of three words; the least of repeated ones is the same, so fingerprints take them as they come."""
    if len(words) < 3:
        return words
    x = words[:-2] * _U(0x9E3779B97F4A7C15) + words[1:-1] * _U(0xC2B2AE3D27D4EB4F) + words[2:] * _U(0x165667B19E3779F9)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def runs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of the different runs of three words."""
    return np.unique(each_run(words)) if len(words) >= 3 else words


def cell(x: np.ndarray) -> np.ndarray:
    return (x >> _U(40)).astype(np.int64) & (CELLS - 1)


class Scheme:
    """One fingerprint: features with two weights, ``segments`` times ``k`` weighted min-wise symbols."""

    def __init__(self, name: int, hot: np.ndarray, weights: tuple[float, float], k: int, segments: int):
        self.hot, self.weights, self.k, self.segments = hot, weights, k, segments
        self.a, self.b = _seeds(name, k * segments)
        self.c, self.d = _seeds(name + 50, k * segments, np.uint64)

    def _least(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.full(len(self.a), np.iinfo(np.uint32).max)
        h = self.a[:, None] * _folded(x)
        h += self.b[:, None]
        return h.min(axis=1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The ball of radius one of each segment: k keys a segment."""
        hot = self.hot[cell(x)]
        often, seldom = self._least(x[hot]), self._least(x[~hot])
        rank = lambda m, w: -np.log1p(-m.astype(np.float64) / (2.0**32 + 1)) / w
        symbols = np.where(rank(often, self.weights[0]) < rank(seldom, self.weights[1]), often, seldom).astype(np.uint64) + _U(1)
        part = symbols * self.c
        part ^= part >> _U(29)
        part = part.reshape(self.segments, self.k)
        key = (part.sum(axis=1, dtype=np.uint64)[:, None] - part).ravel() ^ self.d
        key *= _U(0xD6E8FEB86659FD93)
        return (key ^ (key >> _U(32))).view(np.int64)


_SIG = _seeds(7, SIGNATURE)
_SHIFT = (np.arange(32, dtype=np.uint64) * _U(2))[None, :]


def signature(words: np.ndarray) -> list[int]:
    """64 min-wise symbols of 2 bits in two integers."""
    h = _SIG[0][:, None] * _folded(words)
    h += _SIG[1][:, None]
    low = ((h.min(axis=1) >> np.uint32(7)) & np.uint32(3)).astype(np.uint64)
    return (low.reshape(2, 32) << _SHIFT).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def parities(words: np.ndarray) -> np.ndarray:
    """The bitmap of different words in 64-bit integers: those of two texts differ in no more bits than the texts in words."""
    odd = np.bincount((words >> _U(20)).astype(np.int64) & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_READ = T.StructType([
    T.StructField("g", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("h", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("words", T.ArrayType(T.LongType())),
    T.StructField("runs", T.BooleanType()), T.StructField("cell", T.IntegerType()), T.StructField("texts", T.LongType()),
])


def _read(rows: DataFrame, min_words: int) -> DataFrame:
    """Each text once as the hashes of its words in order (id, h, n, words), and each task's counts of feature cells (runs, cell, texts)."""
    types = (pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.int32(), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        counts: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            hashed = []
            for g, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                own = np.unique(words)
                if len(own) < min_words:
                    continue
                for runs, x in ((False, own), (True, runs_of(words))):
                    if (g, runs) not in counts:
                        counts[g, runs] = np.zeros(CELLS + 1, np.int64)
                    counts[g, runs][cell(x)] += 1
                    counts[g, runs][CELLS] += 1
                for c, v in zip(out, (g, i, xxhash.xxh3_128_digest(own.tobytes()), len(own))):
                    c.append(v)
                hashed.append(words)
            none = [None] * len(out[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, types)), _lists(hashed), *(pa.array(none, t) for t in types[5:])], names=_READ.fieldNames())
        for (g, runs), v in counts.items():
            at = np.nonzero(v)[0]
            none = [None] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((np.full(len(at), g), none, none, none, none, np.full(len(at), runs), at, v[at]), types)], names=_READ.fieldNames())

    return rows.select("g", "id", "text").mapInArrow(read, _READ)


def _recounted(copies: DataFrame) -> DataFrame:
    """Each task's counts (g, runs, cell, texts) of the feature cells of (g, words)."""
    fields = [f for f in _READ.fields if f.name in ("g", "runs", "cell", "texts")]
    types = (pa.int32(), pa.bool_(), pa.int32(), pa.int64())
    order = ("g", "runs", "cell", "texts")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy().view(np.uint64)
            for k, g in enumerate(batch.column(0).to_pylist()):
                words = flat[ends[k] : ends[k + 1]]
                for runs, x in ((False, np.unique(words)), (True, runs_of(words))):
                    if (g, runs) not in counts:
                        counts[g, runs] = np.zeros(CELLS + 1, np.int64)
                    counts[g, runs][cell(x)] += 1
                    counts[g, runs][CELLS] += 1
        for (g, runs), v in counts.items():
            at = np.nonzero(v)[0]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((np.full(len(at), g), np.full(len(at), runs), at, v[at]), types)], names=list(order))

    return copies.select("g", "words").mapInArrow(read, T.StructType(sorted(fields, key=lambda f: order.index(f.name))))


def _frequent(counts: DataFrame) -> tuple[dict[int, int], dict[tuple, np.ndarray]]:
    """Texts per group, and which feature cells are frequent; at most 2 * (CELLS + 1) counts a group come to the driver."""
    counted = materialize(counts.groupBy("g", "runs", "cell").agg(F.sum("texts").alias("n")), "cells")
    least = F.when(F.col("runs"), F.lit(LONG[0])).otherwise(F.lit(SHORT[0]))
    total = counted.filter(F.col("cell") == CELLS).select("g", "runs", F.col("n").alias("texts"))
    texts: dict[int, int] = {}
    marks: dict[tuple, np.ndarray] = {}
    for r in counted.join(F.broadcast(total), ["g", "runs"]).filter(F.col("n") >= F.greatest(F.col("texts") * least, F.when(F.col("cell") == CELLS, 0).otherwise(FREQUENT))).collect():
        if r.cell == CELLS:
            texts[r.g] = r.texts
        else:
            marks.setdefault((r.g, r.runs), np.zeros(CELLS, bool))[r.cell] = True
            if r.runs and r.n >= DENSE[0] * r.texts:
                marks.setdefault((r.g, "dense"), np.zeros(CELLS, bool))[r.cell] = True
    return texts, marks


def _meets(share: float, k: int) -> float:
    """How often a segment of ``k`` symbols differs in one at most, if this share of symbols is equal."""
    return share**k + k * share ** (k - 1) * (1 - share)


def _schemes(texts: dict[int, int], marks: dict) -> dict[tuple[int, str], Scheme]:
    out = {}
    for g, n in texts.items():
        more = max(0, math.ceil(math.log(n / BASE_TEXTS, 16))) if n > BASE_TEXTS else 0
        for seed, (name, runs, (_, often, seldom, k, segments)) in enumerate((("short", False, SHORT), ("long", True, LONG), ("long words", False, LONG_WORDS), ("dense", True, DENSE)), 1):
            held = HELD[runs]
            wide = math.ceil(segments * _meets(held, k) / _meets(held, k + more))
            out[g, name] = Scheme(seed, marks.get((g, "dense" if name == "dense" else runs), np.zeros(CELLS, bool)), (often, seldom), k + more, wide)
    return out


_ODD = [f"p{k}" for k in range(BITS // 64)]
_PRINT = T.StructType([T.StructField("rid", T.LongType()), T.StructField("n", T.IntegerType()), *[T.StructField(f"s{k}", T.LongType()) for k in range(2)], *[T.StructField(p, T.LongType()) for p in _ODD], T.StructField("keys", T.ArrayType(T.LongType()))])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of 64 bits as one list column, without a Python object per element."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))


def _fingerprinted(rows: DataFrame, schemes: dict) -> DataFrame:
    """(rid, n, s0 and s1: signature, p0 and on: bitmap, keys: of all segments and their balls) of (g, rid, n, words)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(3).offsets.to_numpy()
            flat = batch.column(3).values.to_numpy().view(np.uint64)
            keys, signs, odd = [], [], []
            for k, (g, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                words = flat[ends[k] : ends[k + 1]]
                own, parts, dense = np.unique(words), [], []
                if n <= SHORT_TO:
                    parts.append(schemes[g, "short"].keys(own))
                if n >= LONG_FROM:
                    runs = each_run(words)
                    parts += [schemes[g, "long"].keys(runs), schemes[g, "long words"].keys(own)]
                    if schemes[g, "dense"].hot[cell(runs)].mean() >= DENSE_FROM:
                        dense.append(schemes[g, "dense"].keys(runs) | 1)
                every = np.concatenate([*(p & ~1 for p in parts), *dense])  # keys of the dense fingerprint are odd
                keys.append(np.unique(every ^ np.int64(g * 0x5851F42D4C957F2C & (1 << 62) - 1)))
                signs.append(signature(own))
                odd.append(parities(own))
            s0, s1 = zip(*signs) if signs else ([], [])
            bits = np.array(odd, np.int64).reshape(-1, BITS // 64).T
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(s0, pa.int64()), pa.array(s1, pa.int64()), *(pa.array(b) for b in bits), _lists(keys)], names=_PRINT.fieldNames())

    return rows.select("g", "rid", "n", "words").mapInArrow(read, _PRINT)


def similar_pairs(groups: dict[str, DataFrame], *, min_words: int = 12, share: float = 0.7) -> DataFrame:
    """(table_name, id_a, id_b) of every pair with different ids; ``groups`` maps a name to rows of (id, text)."""
    classes, links = _links(groups, min_words, share)
    names = sorted(groups)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("g") + 1)
    member = classes.select("g", "id", "rep")
    a, b = member.select("g", F.col("id").alias("x"), F.col("rep").alias("a")), member.select("g", F.col("id").alias("y"), F.col("rep").alias("b"))
    between = links.select("a", "b").join(a, "a").join(b.drop("g"), "b").select("g", "x", "y").filter("x <> y")
    many = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("rep")
    of = member.join(many, "rep")
    within = of.select("g", F.col("id").alias("x"), "rep").join(of.select(F.col("id").alias("y"), "rep"), "rep").filter("x < y").select("g", "x", "y")
    both = between.unionByName(within)
    return both.select(name.alias("table_name"), F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _links(groups: dict[str, DataFrame], min_words: int, share: float) -> tuple[DataFrame, DataFrame]:
    """Classes (g, id, rep) of texts with one word set, and links (a, b) between representatives."""
    rows = None
    for g, name in enumerate(sorted(groups)):
        own = groups[name].select(F.lit(g).alias("g"), F.col("id").cast("string").alias("id"), "text").filter("id IS NOT NULL AND text IS NOT NULL")
        rows = own if rows is None else rows.unionByName(own)
    read = materialize(_read(rows, min_words).withColumn("rid", F.monotonically_increasing_id()), "read")
    texts = read.filter("cell IS NULL")
    own = materialize(texts.groupBy("g", "h").agg(F.min("rid").alias("rep")), "classes")
    member = texts.select("g", "id", "h", "rid").join(own, ["g", "h"])
    classes = materialize(member.select("g", "id", "rep").distinct(), "members")
    others = materialize(member.filter("rid <> rep").select("rid"), "copies")
    # A class counts once: what its copies were counted is taken off.
    counts = read.filter("cell IS NOT NULL").select("g", "runs", "cell", "texts")
    if not others.isEmpty():
        again = _recounted(texts.join(small(others), "rid", "left_semi"))
        counts = counts.unionByName(again.withColumn("texts", -F.col("texts")))
    schemes = _schemes(*_frequent(counts))
    reps = texts.join(small(others), "rid", "left_anti")
    prints = materialize(_fingerprinted(reps, schemes), "prints")
    keys = prints.select(F.explode("keys").alias("key"), "rid")
    # Keys that a sample shows to be very hot never go to one task: they are combined before the shuffle. Where the sample
    # misses one, the next step counts it; the way taken does not change the result.
    often = prints.filter(F.pmod(F.xxhash64("rid"), F.lit(SAMPLED)) == 0).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    often = materialize(often.filter(F.col("m") >= OFTEN).select("key"), "often")
    crowd = None
    if not often.isEmpty():
        crowd = keys.join(small(often), "key", "left_semi").select("key", "rid")
        keys = keys.join(small(often), "key", "left_anti")
    # One shuffle: keys of one text only, nearly all, end here.
    w = W.partitionBy("key")
    shared = keys.select("key", "rid", F.count(F.lit(1)).over(w).alias("m")).filter("m > 1")
    shared = materialize(shared.groupBy("key").agg(F.collect_list("rid").alias("rids")), "shared")
    texts_of = lambda low, high: shared.filter(F.size("rids").between(low, high)).select("key", "rids", F.explode("rids").alias("rid"))
    near = _in_buckets(texts_of(SIFTED + 1, BUCKET).select("key", "rid"), prints, share)
    met = texts_of(2, SIFTED).select(F.col("rid").alias("a"), F.explode("rids").alias("b")).filter("a < b").distinct()
    near = near.unionByName(_verified(met, prints, share))
    hot = texts_of(BUCKET + 1, 2**31 - 1).select("key", "rid")
    hot = materialize(hot if crowd is None else hot.unionByName(crowd), "hot")
    single, stars, guests = _crowds(hot)
    if not single.isEmpty():
        near = near.unionByName(_verified(_by_rare_words(single, texts, share), prints, share))
    near = materialize(near.distinct(), "near")
    links = materialize(_exact(near, prints, texts, share), "links")
    return classes, _completed(links, stars, guests, near, prints, texts, share)


def _crowds(hot: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What covers each pair of a crowded bucket of ``hot`` (key, rid) once.

    Buckets (rid, l) of texts with few such keys, to be searched each; stars (a, b) that tie the texts with many, or of the
    dense fingerprint, of a bucket (one alone is tied to itself); guests (rid, b), texts with few whose bucket has such a star.
    """
    deep = hot.groupBy("rid").agg(((F.count(F.lit(1)) >= CROWDED) | F.bool_or(F.col("key") % 2 != 0)).alias("deep"))
    marked = materialize(hot.join(deep, "rid"), "marked")
    core, rest = marked.filter("deep").select("key", "rid"), marked.filter("NOT deep").select("key", "rid")
    centre = materialize(core.groupBy("key").agg(F.min("rid").alias("b")), "centres")
    stars = core.join(centre, "key").select(F.col("rid").alias("a"), "b").distinct()
    guests = rest.join(centre, "key").select("rid", "b").distinct()
    return rest.select("rid", F.col("key").alias("l")), materialize(stars, "ties"), materialize(guests, "guests")


def _near(x: str, y: str, share: float) -> Column:
    """Whether sizes (n) and complete signatures (s0, s1) of two sides, named by what stands before these, allow the share."""
    differ = F.lit(0)
    for k in range(2):
        d = F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}"))
        differ = differ + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    # A pair at the share differs in 0.75 * (1 - share) of the symbols on average; four deviations more are let through.
    mean = 0.75 * (1 - share)
    most = SIGNATURE * mean + 4 * math.sqrt(SIGNATURE * mean * (1 - mean))
    return (F.least(f"{x}n", f"{y}n") >= share * F.greatest(f"{x}n", f"{y}n")) & (differ <= most)


def _odd(x: str, y: str, share: float) -> Column:
    """Whether the bitmaps (p0 and on) of two sides, named by what stands before these, allow the share: none that has it is lost."""
    differ = F.lit(0)
    for p in _ODD:
        differ = differ + F.bit_count(F.col(f"{x}{p}").bitwiseXOR(F.col(f"{y}{p}")))
    # Of n and m words, n + m - 2 c are not common, and c is share / (1 + share) of n + m at least.
    return differ <= (F.col(f"{x}n") + F.col(f"{y}n")) * ((1 - share) / (1 + share)) + 1e-6


def _in_buckets(cold: DataFrame, prints: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of one bucket of ``cold`` (key, rid) that sizes, signatures and bitmaps allow; only these leave the bucket."""
    signed = cold.join(prints.select("rid", "n", "s0", "s1", *_ODD), "rid").repartition("key")
    bucket = signed.groupBy("key").agg(F.collect_list(F.struct("rid", "n", "s0", "s1", *_ODD)).alias("texts"))
    pair = bucket.select("texts", F.explode("texts").alias("x")).select("x", F.explode("texts").alias("y")).filter("x.rid < y.rid")
    return pair.filter(_near("x.", "y.", share) & _odd("x.", "y.", share)).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"))


def _sides(pairs: DataFrame, prints: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` (a, b) with these columns of both, named with ``a_`` and ``b_``."""
    for x in "ab":
        pairs = pairs.join(prints.select(F.col("rid").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns]), x)
    return pairs


def _verified(met: DataFrame, prints: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) whose sizes and complete signatures allow the share."""
    return _sides(met, prints, ["n", "s0", "s1"]).filter(_near("a_", "b_", share)).select("a", "b")


def _asked(pairs: DataFrame) -> DataFrame:
    return small(materialize(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct(), "asked"))


def _sifted(near: DataFrame, prints: DataFrame, share: float) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps allow the share."""
    return _sides(near, prints.join(_asked(near), "rid", "left_semi"), ["n", *_ODD]).filter(_odd("a_", "b_", share)).select("a", "b")


def _exact(near: DataFrame, prints: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """Those of the pairs (a, b) that have the share of common words."""
    near = materialize(_sifted(near, prints, share), "sifted")
    words = texts.join(_asked(near), "rid", "left_semi").select("rid", F.array_distinct("words").alias("w"))
    exact = near.join(words.select(F.col("rid").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("rid").alias("b"), F.col("w").alias("wb")), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    union = F.size("wa") + F.size("wb") - common
    return exact.filter(common >= F.lit(share) * union - 1e-9).select("a", "b")


def _completed(links: DataFrame, stars: DataFrame, guests: DataFrame, tried: DataFrame, prints: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """``links`` and the pairs inside groups that fingerprints missed or buckets were too large for; ``stars`` tie the texts of such a bucket, ``guests`` stand in it."""
    group = materialize(_components(links.unionByName(stars)), "components")
    alone = stars.select(F.col("a").alias("v")).distinct().join(group, "v", "left_anti")
    group = group.unionByName(alone.select("v", F.col("v").alias("l"))).select(F.col("v").alias("rid"), "l")
    host = group.select(F.col("rid").alias("b"), "l")
    visit = guests.join(host, "b").select("rid", "l").distinct().join(group, ["rid", "l"], "left_anti")
    group = materialize(group.withColumn("guest", F.lit(False)).unionByName(visit.withColumn("guest", F.lit(True))), "visited")
    group = materialize(group.join(group.groupBy("l").agg(F.count(F.lit(1)).alias("texts")), "l"), "groups")
    few = group.filter(F.col("texts") <= FEW)
    met = few.select("l", F.col("rid").alias("a")).join(few.select("l", F.col("rid").alias("b")), "l").filter("a < b").select("a", "b")
    many = group.filter(F.col("texts") > FEW).select("rid", "l", "guest")
    if not many.isEmpty():
        met = met.unionByName(_by_rare_words(many, texts, share))
    near = materialize(_verified(met.distinct().join(tried, ["a", "b"], "left_anti"), prints, share), "near")
    return links.unionByName(materialize(_exact(near, prints, texts, share), "links"))


def _by_rare_words(groups: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of one group (rid, l) that have one of their rarest words in common: all with the share are among them.

    Texts of n and m words with the share have c = ceil(share (n + m) / (1 + share)) in common at least, so one of the
    n - c + 1 rarest words of the one is among the m - c + 1 rarest of the other. This is at most n - ceil(share n) + 1 for
    the longer one, and m - ceil(2 share m / (1 + share)) + 1 for the other. Two guests (rid, l, guest) are no pair.
    """
    if "guest" not in groups.columns:
        groups = groups.withColumn("guest", F.lit(False))
    own = ["rid", "l", "n", "guest"]
    words = materialize(groups.join(texts.select("rid", "n", F.array_distinct("words").alias("ws")), "rid").select(*own, F.explode("ws").alias("w")), "words")
    often = words.groupBy("l", "w").agg(F.count(F.lit(1)).alias("df"))
    # A word of one text of the group is no key, but takes its place among the rarest.
    ranked = words.join(often, ["l", "w"]).groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("ws"))
    probe = (F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1).cast("int")
    index = (F.col("n") - F.ceil(2 * share / (1 + share) * F.col("n") - 1e-9) + 1).cast("int")
    ranked = ranked.select(*own, index.alias("index"), F.posexplode(F.slice("ws", F.lit(1), probe)).alias("pos", "x")).filter("x.df > 1")
    ranked = materialize(ranked.select(*own, "pos", (F.col("pos") < F.col("index")).alias("first"), F.col("x.w").alias("w")), "rare")
    side = lambda x: [F.col(c).alias(f"{c}{x}") for c in ("rid", "n", "guest", "pos")]
    met = ranked.select("l", "w", *side("x")).join(ranked.filter("first").select("l", "w", *side("y")), ["l", "w"])
    met = met.filter("(ny < nx OR ny = nx AND ridy < ridx) AND NOT (guestx AND guesty)").filter(F.col("ny") >= share * F.col("nx") - 1e-9)
    common = F.ceil(share / (1 + share) * (F.col("nx") + F.col("ny")) - 1e-9)
    met = met.filter((F.col("posx") <= F.col("nx") - common) & (F.col("posy") <= F.col("ny") - common))
    return met.select(F.least("ridx", "ridy").alias("a"), F.greatest("ridx", "ridy").alias("b")).distinct()


def _components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, l): the smallest node of the component of each node of ``links`` (a, b).

    Links are turned into stars: every node's larger neighbours, then its smaller ones and itself, are hung on the
    smallest of them, until each node hangs on one that hangs nowhere. A chain takes a logarithmic number of rounds.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("l")).filter("v <> l").distinct(), "stars")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("l").alias("v"), F.col("v").alias("l")))
        least = both.groupBy("v").agg(F.least(F.col("v"), F.min("l")).alias("m"))
        large = both.filter("l > v").join(least, "v").select(F.col("l").alias("v"), F.col("m").alias("l")).distinct()
        large = materialize(large, "stars")
        least = large.groupBy("v").agg(F.min("l").alias("m"))
        small_ = large.join(least, "v").select(F.col("l").alias("v"), F.col("m").alias("l")).filter("v <> l")
        edges = materialize(small_.unionByName(least.withColumnRenamed("m", "l")).distinct(), "stars")
        if edges.groupBy("v").count().filter("count > 1").isEmpty() and edges.join(edges.select(F.col("v").alias("l")), "l", "left_semi").isEmpty():
            return edges.unionByName(edges.select(F.col("l").alias("v"), "l").distinct())
    raise RuntimeError(f"components not finished after {rounds} rounds")


def duplicate_groups(groups: dict[str, DataFrame], *, min_words: int = 12, share: float = 0.7, rounds: int = 60) -> DataFrame:
    """(table_name, id, class_id, links): records that are copies of others, with the smallest id of their component."""
    classes, links = _links(groups, min_words, share)
    names = sorted(groups)
    edges = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    label = _components(links, rounds)
    degree = edges.groupBy("a").agg(F.count(F.lit(1)).alias("links"))
    many = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("least"))
    known = many.join(label.withColumnRenamed("v", "rep"), "rep", "left").join(degree.withColumnRenamed("a", "rep"), "rep", "left").filter("l IS NOT NULL OR members > 1")
    known = known.withColumn("l", F.coalesce("l", "rep"))
    first = known.groupBy("l").agg(F.min("least").alias("class_id"))
    out = classes.join(known, "rep").join(first, "l")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("g") + 1)
    return out.select(name.alias("table_name"), "id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"))
