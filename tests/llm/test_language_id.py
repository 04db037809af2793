import itertools
import random

import numpy as np

from docloom.llm import language_id as L

SYLLABLES = {"aa": ["ba", "lo", "mi", "ro"], "bb": ["sch", "ung", "eit", "kan"], "cc": ["eaux", "tre", "oi", "que"]}


def texts(seed, n):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        out.append((" ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 200))), lang))
    return out


def test_forward_backward_equals_enumeration():
    rnd = np.random.default_rng(0)
    scores, transition = rnd.normal(size=(1, 4, 3)), rnd.normal(size=(3, 3))
    weight = {}
    for path in itertools.product(range(3), repeat=4):
        weight[path] = np.exp(sum(scores[0, t, y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
    total = sum(weight.values())
    marginal, expected = L.forward_backward(scores, transition, np.array([4]))
    for t in range(4):
        for y in range(3):
            assert abs(marginal[0, t, y] - sum(w for p, w in weight.items() if p[t] == y) / total) < 1e-9
    pair = np.zeros((3, 3))
    for path, w in weight.items():
        for a, b in zip(path, path[1:], strict=False):
            pair[a, b] += w / total
    assert np.abs(pair - expected).max() < 1e-9


def test_short_chains_ignore_padding():
    rnd = np.random.default_rng(1)
    scores, transition = rnd.normal(size=(1, 3, 2)), rnd.normal(size=(2, 2))
    padded = np.concatenate([scores, np.zeros((1, 5, 2))], 1)
    a, x = L.forward_backward(scores, transition, np.array([3]))
    b, y = L.forward_backward(padded, transition, np.array([3]))
    assert np.abs(a - b[:, :3]).max() < 1e-9 and np.abs(x - y).max() < 1e-9


def test_held_out_accuracy_and_code_switching():
    model = L.train(*zip(*texts(1, 150), strict=True))
    held = texts(2, 90)
    lang, score, _ = model.predict([t for t, _ in held])
    assert np.mean([a == b for a, (_, b) in zip(lang, held, strict=True)]) > 0.97 and ((score >= 0) & (score <= 1)).all()
    mixed = "balomi romiba lolo " * 3 + "schung eitkan ungeit " * 3
    _, each = model.words([mixed])
    got = [model.labels[k] for k in each.argmax(1)]
    assert got == ["aa"] * 9 + ["bb"] * 9


def test_queries_shape(spark):
    rows = [(t, i, lang, "x") for i, (t, lang) in enumerate(texts(3, 60))] + [(None, 100, "aa", "x"), ("123 !!", 101, None, "x"), ("", 102, "bb", "x"), ("ÄÖ ung", 103, None, "x")]
    docs = spark.createDataFrame(rows, "text string, doc_id long, lang string, lang_pred string")
    model = L.learn(docs)
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102)) and got[103].lang_pred in SYLLABLES
    kept = L.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {100, 101, 102}
    nothing = L.learn(docs.where("false"))
    assert {(r.lang_pred, r.score) for r in L.identify(docs, nothing).collect()} == {("und", 0.0)}
    assert L.identify(docs.where("false"), model).collect() == []


def test_labelled_words(spark):
    model = L.train(*zip(*texts(1, 150), strict=True))
    mixed = " balomi, romiba lolo " + "schung eitkan ungeit"
    docs = spark.createDataFrame([(mixed, 1, 0), (None, 2, 0), ("12 !", 3, 0), (mixed, 1, 0), ("\U0001f600 balomi " * 3000, 4, 0)], "text string, doc_id long, words int").coalesce(1)
    got = L.label_words(docs, model).collect()
    assert [r.doc_id for r in got] == [1, 2, 3, 1, 4] and got[0] == got[3] and got[1].words == got[2].words == []
    assert [mixed[w.start : w.end] for w in got[0].words] == mixed.replace(",", " ").split() and [w.lang for w in got[0].words] == ["aa"] * 3 + ["bb"] * 3
    assert len(got[4].words) == 3000 and got[4].words[1].start == 11 and all(0 <= w.score <= 1 for w in got[4].words)
    assert all(r.words == [] for r in L.label_words(docs, L.train([], [])).collect())


def test_a_mixed_text_is_kept(spark):
    model = L.train(*zip(*texts(1, 150), strict=True))
    docs = spark.createDataFrame([(1, "balomi romiba lolo " * 4 + "schung eitkan ungeit " * 4)], "doc_id long, text string")
    assert L.keep_identified(docs, model, least=0.8).count() == 1 and L.identify(docs, model).first().score < 0.8
