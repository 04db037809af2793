import random
import re

import pyarrow as pa

from docloom.llm.decontam import Myers, contaminated, drop_contaminated, find_quotes, normal


def clean(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")).strip(" ").encode()


def within(pattern, text):
    """Least edit distance of pattern to a substring of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_normal():
    texts = ["  A \n b ", "", None, " ", "x", "É  É\x0b", "\tz", "y "]
    data, at = normal(pa.array(texts))
    assert [data.tobytes()[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] == [clean(t) for t in texts]


def test_myers_equals_the_table():
    rnd = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, n))).encode() for n in (12, 40))
        assert Myers(p).best(t)[0] == within(p, t)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "in", "ea", "st"]) for _ in range(rnd.randint(1, 4)))
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 20, 40])))) for i in range(12)] + [(50, None), (51, " "), (52, "É ü quote of letters beyond ascii ßß")]
    docs = []
    for i in range(80):
        text = " ".join(word() for _ in range(rnd.randint(0, 60)))
        if i % 2:
            quote = list(rnd.choice(items[:12])[1].upper() if i % 4 == 1 else rnd.choice(items[:12])[1])
            for _ in range(rnd.choice([0, 0, 1, 3, 9, 30])):
                at = rnd.randrange(len(quote) + 1)
                quote[at : at + rnd.randint(0, 1)] = rnd.choice(["", "q", "  "])
            text = text[:50] + " " + "".join(quote) + " " + text[50:]
        docs.append((text, i, "x"))
    return docs + [(None, 900, "x"), ("", 901, "x"), ("say É  Ü quote of letters beyond ascii ßß", 902, "x"), (docs[1][0], 1, "x")], items


def test_equals_brute_force(spark):
    for seed, block_bytes in ((1, 4 << 20), (2, 300)):
        docs, items = corpus(seed)
        rate, piece = 0.08, 12
        want = set()
        for t, i, _ in docs:
            for n, item in items:
                p = clean(item)
                if p and t is not None:
                    budget = max(0, min(int(rate * len(p)), len(p) // piece - 1))
                    edits = within(p, clean(t))
                    if edits <= budget:
                        want.add((i, n, edits))
        d = spark.createDataFrame(docs, "text string, doc_id long, item_id string").repartition(3)
        b = spark.createDataFrame(items + items[:3], "item_id long, text string")
        got = find_quotes(d, b, rate=rate, piece=piece, block_bytes=block_bytes)
        assert set(map(tuple, got.collect())) == want
        dirty = {i for i, _, _ in want}
        kept = drop_contaminated(d, b, rate=rate, piece=piece, block_bytes=block_bytes)
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for _, i, _ in docs} - dirty
        assert {r.doc_id: r.item_ids for r in contaminated(d, b).collect()} == {i: sorted({n for j, n, _ in want if j == i}) for i in dirty}


def test_empty(spark):
    d = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert find_quotes(d, b.where("false")).collect() == [] and find_quotes(d.where("false"), b).collect() == []
    assert drop_contaminated(d, b.where("false")).count() == 1 and find_quotes(d, b).count() == 1


def test_items_of_equal_id_give_one_row(spark):
    d = spark.createDataFrame([(1, "first quoted passage of words, second quoted passage of words"), (None, "first quoted passage of words"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "first quoted passage of words"), (7, "second quoted passage of w0rds"), (7, "first quoted passage of words"), (None, "second")], "item_id long, text string")
    for block_bytes in (4 << 20, 8):
        got = sorted(((r.doc_id or 0, r.item_id, r.edits) for r in find_quotes(d, b, block_bytes=block_bytes).collect()))
        assert got == [(0, 7, 0), (1, 7, 0)]


def test_very_long_texts_and_items(spark):
    rnd = random.Random(4)
    item = " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(3000))
    near = item[:7000] + "X" + item[7003:]
    d = spark.createDataFrame([(1, "some words " * 100000 + near + " and more" * 1000), (2, "some words " * 100000)], "doc_id long, text string")
    b = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.edits) for r in find_quotes(d, b).collect()] == [(1, 5, 3)]
    assert [r.doc_id for r in drop_contaminated(d, b).collect()] == [2]
