import random
import re
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from lessonloom.llm import near_duplicates as N


def words(t):
    return frozenset(re.findall(r"[^\W_]+", unicodedata.normalize("NFC", t).lower()))


def brute(rows):
    one = {i: words(t) for i, t in rows if i is not None and t is not None}
    ids = sorted(i for i, w in one.items() if len(w) >= 12)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(one[a] & one[b]) * 10 >= 7 * len(one[a] | one[b])}


def corpus():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        n = r.choice([14, 30, 60, 70, 95, 100, 250])
        base = r.sample(vocabulary, n)
        rows.append((f"a{k:03}", " ".join(base)))
        for j in range(r.choice([0, 1, 2])):
            new = list(base)
            for _ in range(int(n * r.choice([0, 0.03, 0.1]))):
                new[r.randrange(n)] = r.choice(vocabulary)
            if r.random() < 0.3:
                cut = r.randrange(n)
                new = new[cut:] + new[:cut]
            rows.append((f"b{k:03}{j}", " ".join(new).upper() + "!"))
    return rows


def test_pairs_equal_brute_force(spark):
    rows = [*corpus(), ("n", None), ("e", ""), ("s", "too few words here"), (None, "x " * 20)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "id string, text string")
    got = [(r.id_a, r.id_b) for r in N.similar_pairs({"t": df}).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want - set(got)) <= 0.02 * len(want) and len(want) > 30


def test_tables_do_not_mix_and_copies_pair(spark):
    text = " ".join(f"u{i}" for i in range(20))
    a = spark.createDataFrame([("1", text), ("2", text), ("3", text + " more"), ("3", text + " more")], "id string, text string")
    b = spark.createDataFrame([("1", text)], "id string, text string")
    got = {tuple(r) for r in N.similar_pairs({"a": a, "b": b}).collect()}
    assert got == {("a", "1", "2"), ("a", "1", "3"), ("a", "2", "3")}
    g = {(r.id, r.class_id, r.links) for r in N.duplicate_groups({"a": a, "b": b}).collect()}
    assert {(i, c) for i, c, _ in g} == {("1", "1"), ("2", "1"), ("3", "1")}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert N.similar_pairs({"a": df}).count() == 0 and N.duplicate_groups({"a": df}).count() == 0


def test_groups_are_components(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id string, text string")
    pairs = {(r.id_a, r.id_b) for r in N.similar_pairs({"t": df}).collect()}
    root = {i: i for p in pairs for i in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.class_id for r in N.duplicate_groups({"t": df}).collect()}
    assert got == {i: find(i) for i in root}


def test_reordered_items_meet_at_any_size():
    r = random.Random(13)
    pairs = []
    for _ in range(300):
        items = [[f"w{r.randrange(10**6)}" for _ in range(5)] for _ in range(30)]
        new = [[f"x{r.randrange(10**6)}" if r.random() < 0.1 else w for w in i] for i in items]
        r.shuffle(new)
        pairs.append([N.words_of(" ".join(w for i in x for w in i)) for x in (items, new)])
    for n in (300_000, 500_000, 50_000_000):
        schemes = N._schemes({0: n}, {})
        keys = lambda w: set(np.concatenate([s.keys(N.runs_of(w) if name == "long" else np.unique(w)) for (_, name), s in schemes.items() if name in ("long", "long words")]).tolist())  # noqa: E731, B023
        assert sum(bool(keys(a) & keys(b)) for a, b in pairs) >= 297


def test_a_long_chain_is_one_group(spark):
    # Neighbours share 35 of 45 words, the next but one 30 of 50; ids and rows are in random order.
    r = random.Random(7)
    rows = [(f"c{i}", " ".join(f"w{j}" for j in range(5 * k, 5 * k + 40))) for k, i in enumerate(r.sample(range(1000, 2000), 1000))]
    r.shuffle(rows)
    got = N.duplicate_groups({"t": spark.createDataFrame(rows, "id string, text string")}).collect()
    assert len(got) == 1000 and {x.class_id for x in got} == {"c1000"}


def test_a_third_of_the_rows_are_edited_copies(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    base, rows = r.sample(vocabulary, 150), []
    for k in range(150):
        copy = [r.choice(vocabulary) if r.random() < 0.075 else w for w in base]
        rows.append((f"h{k:03}", " ".join(copy)))
    rows += [(f"o{k:03}", " ".join(r.sample(vocabulary, 150))) for k in range(300)]
    got = {(x.id_a, x.id_b) for x in N.similar_pairs({"t": spark.createDataFrame(rows, "id string, text string")}).collect()}
    want = brute(rows)
    assert got <= want and len(want) > 5000
    assert len(want - got) <= 0.02 * len(want)


def test_copies_count_once(spark):
    r = random.Random(12)
    text = " ".join(r.sample([f"w{i}" for i in range(5000)], 150))
    df = spark.createDataFrame([(f"c{k}", text) for k in range(60)] + [("e", text + " more")], "id string, text string")
    counted = []
    real = N._schemes
    N._schemes = lambda texts, marks: counted.append((texts, marks)) or real(texts, marks)
    try:
        assert N.similar_pairs({"t": df}).count() == 61 * 60 // 2
    finally:
        N._schemes = real
    assert counted[0][0] == {0: 2} and not counted[0][1]


def test_texts_of_one_template_meet_by_own_words(spark, monkeypatch):
    # 52 shared and 12 own words: a share of 0.68, and 0.7 with one own word in common.
    r = random.Random(17)
    shared = [f"t{i}" for i in range(52)]
    rows = [(f"k{k:04}", shared + [f"w{r.randrange(10**6)}" for _ in range(12)]) for k in range(1500)]
    rows += [(f"p{k:04}", [*w[:-4], *(f"x{k}{j}" for j in range(4))]) for k, (_, w) in enumerate(rows[:100])]
    df = spark.createDataFrame([(i, " ".join(r.sample(w, 64))) for i, w in rows], "id string, text string")
    met = []
    real = N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *a: met.append(pairs.count()) or real(pairs, *a))
    got = {(x.id_a, x.id_b) for x in N.similar_pairs({"t": df}).collect()}
    want = brute([(i, " ".join(w)) for i, w in rows])
    # Pairs at 0.7 that share the template and one word are met by chance only (README); the planted copies, at 0.88, are found.
    assert got <= want and sum((f"k{k:04}", f"p{k:04}") in got for k in range(100)) >= 99
    assert sum(met) < 25 * len(rows)


def test_groups_are_searched_exactly(spark):
    r = random.Random(19)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(60):
        w = base[:]
        for _ in range(r.choice([2, 6, 12, 16])):
            w[r.randrange(100)] = f"e{r.randrange(400)}"
        rows.append((k, r.sample(w, r.choice([100, 97, 90]))))
    texts = spark.createDataFrame([(k, len(set(w)), [hash(x) for x in w]) for k, w in rows], "rid long, n int, words array<long>")
    groups = spark.createDataFrame([(k, 0) for k, _ in rows], "rid long, l long")
    got = {(x.a, x.b) for x in N._by_rare_words(groups, texts, 0.7).collect()}
    sets = {k: set(w) for k, w in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    assert want <= got and len(want) > 100


def test_pairs_that_meet_in_crowded_buckets_only_are_found(spark, monkeypatch):
    # Every text stands in one bucket of 160; some stand in 16 more, and are searched in a group that the others visit.
    r = random.Random(23)
    rows = []
    for k in range(80):
        base = [f"w{k}x{j}" for j in range(20)]
        rows += [(f"a{k:02}", " ".join(base)), (f"b{k:02}", " ".join([*base[:18], "y", f"z{k}"]))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, text string")
    want = {(f"a{k:02}", f"b{k:02}") for k in range(80)}
    assert brute(rows) == want
    real = N._fingerprinted
    for deep in ("false", "rid % 2 = 0", "rid < 40 AND rid % 2 = 0"):
        keys = F.expr(f"IF({deep}, sequence(2L, 34L, 2L), array(2L))")
        monkeypatch.setattr(N, "_fingerprinted", lambda x, schemes, keys=keys: real(x, schemes).withColumn("keys", keys))
        assert {(x.id_a, x.id_b) for x in N.similar_pairs({"t": df}).collect()} == want, deep


def test_bitmaps_lose_no_pair():
    r = random.Random(29)
    for n in (12, 30, 100, 600, 1500):
        for edits in (0, 1, n // 10, n // 4, n):
            a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
            b = np.unique(np.concatenate([a[edits:], np.array([r.getrandbits(64) for _ in range(edits)], np.uint64)]))
            differ = sum((int(x) & 2**64 - 1).bit_count() for x in N.parities(a) ^ N.parities(b))
            assert differ <= len(np.setxor1d(a, b)) and (differ > 0) == (edits > 0)


def test_words_are_sent_of_likely_pairs_only(spark, monkeypatch):
    # Texts of 30 templates, 0.6 alike: all meet in buckets, only the 15 planted copies are pairs.
    r, rows = random.Random(31), []
    for t in range(30):
        for k in range(24):
            rows.append((f"a{t:02}-{k:02}", [*(f"t{t}x{j}" for j in range(24)), *(f"o{r.randrange(10**6)}" for _ in range(8))]))
    rows += [("b" + i[1:], [*w[:-1], f"e{i}"]) for i, w in rows[::48]]
    rows = [(i, " ".join(r.sample(w, len(w)))) for i, w in rows]
    df = spark.createDataFrame(rows, "id string, text string")
    written = []
    real = N.materialize
    monkeypatch.setattr(N, "materialize", lambda x, name="part": written.append((name, y := real(x, name))) or y)
    got = {(x.id_a, x.id_b) for x in N.similar_pairs({"t": df}).collect()}
    assert got == brute(rows) and len(got) == 15
    names = [name for name, _ in written]
    # "asked" before "links" are the texts whose words are compared.
    assert 30 <= written[names.index("links") - 1][1].count() <= 60


def test_crowded_buckets_are_searched_whole_at_any_bound(spark, monkeypatch):
    r = random.Random(37)
    rows = []
    for k in range(60):
        base = [f"w{k}x{j}" for j in range(20)]
        rows += [(f"a{k:02}", " ".join(base)), (f"b{k:02}", " ".join([*base[:18], "y", f"z{k}"]))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, text string")
    want = {(f"a{k:02}", f"b{k:02}") for k in range(60)}
    real = N._fingerprinted
    keys = F.expr("IF(rid % 2 = 0, sequence(2L, 34L, 2L), array(2L))")
    monkeypatch.setattr(N, "_fingerprinted", lambda x, schemes: real(x, schemes).withColumn("keys", keys))
    for bound in (32, 80, 119, 120):
        monkeypatch.setattr(N, "BUCKET", bound)
        assert {(x.id_a, x.id_b) for x in N.similar_pairs({"t": df}).collect()} == want, bound
