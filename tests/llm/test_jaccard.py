import random
import re

import numpy as np

from docloom.llm import jaccard
from docloom.llm.jaccard import Index, Rule, block_labels, jaccard_components


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, num, den):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    label = {i: i for i, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i)) for i, s in sets)


def corpus(seed, n):
    rnd = random.Random(seed)
    passage = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(40)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE two")]
    bases = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.choice([4, 9, 12, 25, 60, 150]))] for _ in range(n // 6)]
    for i in range(n):
        words = list(rnd.choice(bases))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4, 8])):
            at = rnd.randrange(len(words))
            words[at : at + 1] = rnd.choice([[], [words[at], "x"], [f"y{rnd.randint(0, 9)}"]]) or words[at : at + 1]
        if rnd.random() < 0.3:
            at = rnd.randrange(len(words) + 1)
            words[at:at] = passage
        rows.append((10 + i, " ".join(words)))
    return rows


def test_index_finds_what_brute_force_finds():
    rnd = np.random.default_rng(3)
    for num, den in ((9, 10), (8, 10), (1, 2)):
        rule = Rule(num, den)
        base = [np.sort(rnd.choice(2000, rnd.integers(1, 80), replace=False)).astype(np.uint64) for _ in range(30)]
        sets = []
        for _ in range(150):
            s = base[rnd.integers(len(base))]
            s = s[rnd.random(len(s)) > rnd.choice([0, 0.02, 0.1])]
            sets.append(np.unique(np.concatenate([s, rnd.choice(2000, rnd.integers(0, 4)).astype(np.uint64)])))
        index = Index(sets, rule)
        for q in sets:
            want = [i for i, s in enumerate(sets) if len(s) and den * len(np.intersect1d(q, s)) >= num * len(np.union1d(q, s))]
            assert index.search(q).tolist() == (want if len(q) else [])


def test_block_labels_are_components():
    sets = [np.arange(a, a + 20, dtype=np.uint64) for a in (0, 40, 1, 80, 2, 41, 3)]
    assert block_labels(list(range(7)), sets, Rule(9, 10)) == [0, 1, 0, 3, 0, 1, 0]


def test_components_equal_brute_force(spark, monkeypatch):
    for seed, (size, num, den), block in ((1, (3, 90, 100), 1 << 20), (2, (5, 8, 10), 300), (3, (3, 90, 100), 150), (4, (2, 8, 10), 400)):
        rows = corpus(seed, 150)
        monkeypatch.setattr(jaccard, "HOT", 3 if seed % 2 else 8)
        docs = spark.createDataFrame([(t, i, 7) for i, t in rows], "text string, doc_id long, n_shingles long")
        got = jaccard_components(docs, size=size, num=num, den=den, sample=40, block=block, block_sets=5 if seed > 2 else 192, group=4 if seed > 1 else 1024)
        assert sorted(map(tuple, got.collect())) == brute(rows, size, num, den)


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert jaccard_components(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, schema)).collect()))
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_strings_made_to_collide_are_not_linked(spark):
    tm = lambda a, b, n: "".join(b if i.bit_count() & 1 else a for i in range(n))
    rows = [(1, tm("a", "b", 2048)), (2, tm("b", "a", 2048)), (3, tm("b", "a", 2048)), (4, tm("x", "y", 1024) + " q"), (5, tm("y", "x", 1024) + " q")]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 2), (4, 1, 4), (5, 1, 5)]


def test_a_large_group_of_near_copies(spark):
    rnd = random.Random(12)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(150)]
    rows = []
    for i in range(400):  # a chain of changes: many are not linked with the first
        at = rnd.randrange(len(base))
        if i % 5 == 0:
            base = [*base[:at], f"v{i}", *base[at + 1 :]]
        text = list(base)
        text[rnd.randrange(len(text))] = f"u{i}"
        rows.append((i, " ".join(text)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=5, num=8, den=10, block_sets=50, group=60)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 8, 10)


def test_very_long_texts(spark):
    rnd = random.Random(6)
    words = [f"w{rnd.randint(0, 9999)}" for _ in range(60000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:58000])), (3, " ".join(words[:40000])), (4, "x" * 500000)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows, 5, 8, 10)


def test_rows_without_some_ids(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS k", "concat('t', id) AS text").repartition(3)
    for bits in (1 << 26, 1 << 16):
        monkeypatch.setattr(jaccard, "BITMAP", bits)
        for gone in (docs.where("k % 7 = 0").select("k"), docs.where("false").select("k"), docs.select("k")):
            want = {r.k for r in docs.collect()} - {r.k for r in gone.collect()}
            got = jaccard.without(docs, gone, "k")
            assert got.columns == docs.columns and {(r.k, r.text) for r in got.collect()} == {(k, f"t{k}") for k in want}


def test_sets_with_many_common_signatures_are_one_row(spark, monkeypatch):
    """Copies sign once, and two near copies of a long text are held against each other once, not once for each signature."""
    rnd, written, plain = random.Random(8), {}, jaccard.materialize
    long = [[f"w{rnd.randint(0, 9999)}" for _ in range(600)] for _ in range(3)]
    rows = [(10 * i + j, " ".join(words)) for i, words in enumerate(long) for j in range(5)]
    rows += [(100 + i, " ".join([*words[:-4], "x"])) for i, words in enumerate(long[:2])]
    monkeypatch.setattr(jaccard, "materialize", lambda df, name: written.setdefault(name, plain(df, name)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 8, 10)
    assert written["shared-signatures"].count() == 2


def test_groups_that_go_over_batches(spark, monkeypatch):
    rows = corpus(5, 150)
    monkeypatch.setattr(jaccard, "HOT", 8)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs, before = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.conf.get(key)
    try:
        for size, group in ((2, 4), (7, 3), (5, 1024)):
            spark.conf.set(key, size)
            got = jaccard_components(docs, size=5, num=8, den=10, sample=40, group=group)
            assert sorted(map(tuple, got.collect())) == brute(rows, 5, 8, 10)
    finally:
        spark.conf.set(key, before)
