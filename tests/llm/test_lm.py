import functools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import lm, queries, storage, vectext
from docloom.llm.lm import Chunk, Counts, Filter, count_of, level_of, pack_ints, score_documents, tokens, unpack_ints


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\0end"]


def test_columns_round_trip():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 1000):
        columns = [(rnd.integers(0, 1 << 62, n).astype(np.uint64), 8), (rnd.integers(0, 1 << 31, n), 4), (rnd.integers(0, 2, n // 2).astype(bool), 1)]
        assert all((a == b).all() for (a, _), b in zip(columns, unpack_ints(pack_ints(*columns)), strict=True))


def test_levels():
    counts = np.arange(1, 50000)
    level = level_of(counts)
    assert (np.diff(level) >= 0).all() and (count_of(level[: lm.EXACT]) == counts[: lm.EXACT]).all()
    assert (np.abs(np.log(count_of(level) / counts)) <= math.log(lm.BASE)).all() and count_of(np.array([0]))[0] == 0


def test_filter_never_loses_and_rarely_adds():
    rnd = np.random.default_rng(2)
    key = np.unique(rnd.integers(0, 1 << 48, 30000).astype(np.uint64))
    level = level_of(np.minimum(rnd.zipf(1.6, len(key)), 10**6))
    held = Filter(key, level)
    got = held.level(key)
    assert (got >= level).all() and (got > level).mean() < 0.01
    assert (held.level(np.unique(rnd.integers(0, 1 << 48, 30000).astype(np.uint64))) > 0).mean() < 0.01


def test_counts_tell_equal_first_halves_apart():
    counts = Counts(2)
    rnd, want = np.random.default_rng(5), Counter()
    for _ in range(80):
        h, g, c = rnd.integers(0, 9, 20).astype(np.uint64), rnd.integers(0, 9, 20).astype(np.uint64), rnd.integers(0, 4, 20)
        for key in zip(h.tolist(), g.tolist(), c.tolist(), strict=True):
            want[key[:2]] += key[2]
        counts.add(h, g, c)
    counts.settle()
    asked = [(a, b) for a in range(11) for b in range(11)]
    got = counts.find(*(np.array(x, np.uint64) for x in zip(*asked, strict=True)))
    assert got.tolist() == [want[k] for k in asked]


def test_chunks_round_trip():
    text, h, g = tokens(pa.array(["A b", None, "a  B "]))
    assert text.tolist() == [0, 0, 0, 1, 2, 2, 2] and (h[:3] == h[4:]).all() and h[3] == lm.END
    chunk = Chunk.unpacked(Chunk.of(np.bincount(text), np.array([True, False, True]), h, g).packed())
    assert (chunk.key[chunk.back] == h).all() and (chunk.check[chunk.back] == g).all()
    chunk.grams()
    assert (chunk.pair[:3] == chunk.pair[4:]).all() and len(set(chunk.pair.tolist())) == 4
    assert chunk.word_count[chunk.back].tolist() == [2, 2, 2, 2, 2, 2, 2] and chunk.pair_count[chunk.pair].tolist() == [2, 2, 2, 0, 2, 2, 2]


def counted(texts):
    single, pair = Counter(), Counter()
    for text in texts:
        ws = words(text)
        single.update(ws)
        pair.update(zip(["\0end", *ws], ws, strict=False))
    return single, pair


@functools.cache
def quantised(c):
    return float(count_of(level_of(np.array([c])))[0]) if c else 0.0


def probability(before, w, single, pair, space):
    both = quantised(min(pair.get((before, w), 0), single.get(before, 0), single.get(w, 0)))
    return (both + lm.PRIOR * (quantised(single.get(w, 0)) + 1) / space) / (quantised(single.get(before, 0)) + lm.PRIOR)


def total(single):
    return sum(quantised(c) for c in single.values()) + len(single) + 1


def plain_score(text, single, pair):
    """The model's score of a text from levelled counts held in dictionaries."""
    ws, space = words(text), total(single)
    return sum(math.log10(probability(a, b, single, pair, space)) for a, b in zip(["\0end", *ws], ws, strict=False))


def corpus():
    rnd = np.random.default_rng(3)
    vocabulary = [f"W{i}" for i in range(300)]
    rows = [(" ".join(rnd.choice(vocabulary, rnd.integers(1, 60), p=np.arange(300, 0, -1) / 45150)), i, 1.0) for i in range(300)]
    return rows + [(None, 1000, 1.0), ("", 1001, 1.0), ("never Seen", 1002, 1.0), (rows[5][0], 1003, 1.0), (rows[5][0], 1003, 1.0), ("W1 W2 " * 9000, 1004, 1.0)]


def test_probabilities_sum_to_one():
    single, pair = counted(t for t, i, _ in corpus() if i < 250 or i == 1004)
    for before in [*list(single)[:40], "w1", "w2", "\0end", "never"]:
        both = sum(probability(before, w, single, pair, total(single)) for w in [*single, "never"])
        assert abs(both - 1) < lm.BASE - 1, (before, both)


@pytest.mark.parametrize("options", [{}, {"range_tokens": 300}, {"range_tokens": 500, "chunk_tokens": 400}, {"chunk_tokens": 1}])
def test_scores(spark, options):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, doc_id long, score double").repartition(3)
    single, pair = counted(t for t, i, _ in rows if i < 250)
    n, v = sum(single.values()), len(single)
    got = score_documents(docs, F.col("doc_id") < 250, **options).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for _, i, _ in rows)
    texts, off = {i: t for t, i, _ in rows}, []
    for r in got:
        ws = words(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(single[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((single[w] + 1) / (n + v + 1)) for w in ws)) < 1e-9 * len(ws)
        off.append(abs(r.score - plain_score(texts[r.doc_id], single, pair)) / len(ws))
    # a false hit of the filter raises a count by a level
    assert np.mean(np.array(off) < 1e-9) > 0.5 and max(off) < 0.1


def test_held_out_texts_score_better_than_by_words_alone(spark):
    got = score_documents(spark.createDataFrame([(i, "the cat sat on the mat and the dog sat on the cat " * (1 + i % 3)) for i in range(40)], "doc_id long, text string"), F.col("doc_id") % 4 != 1).collect()
    assert all(r.score > r.base_score for r in got)


def test_ngrams_seen_once_count(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(40)]  # every word and pair once
    docs = spark.createDataFrame(rows + [(99, "never seen words")], "doc_id long, text string")
    single, pair = counted(t for _, t in rows)
    got = {r.doc_id: r.score for r in score_documents(docs, F.col("doc_id") < 99).collect()}
    assert np.mean([abs(got[i] - plain_score(t, single, pair)) < 1e-9 for i, t in rows]) > 0.5
    assert abs(got[99] - plain_score("never seen words", single, pair)) < 0.5


def test_words_made_to_collide_are_told_apart(spark):
    tm = lambda a, b, n: "".join(b if i.bit_count() & 1 else a for i in range(n))
    rows = [(i, t) for i, t in enumerate([tm("a", "b", 2048), tm("b", "a", 2048), tm("a", "b", 1024)] * 2 + [tm("a", "b", 2048)])]
    got = {r.doc_id: (r.n_known, r.base_score) for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") != 1).collect()}
    assert got[0][1] > got[1][1] and got[1][0] == 2


def test_a_shared_first_half_is_told_apart(spark, monkeypatch):
    plain = vectext.span_hash
    monkeypatch.setattr(vectext, "span_hash", lambda *a: (plain(*a)[0] % np.uint64(3), plain(*a)[1]))
    text, h, g = tokens(pa.array(["a b c d e f g h a b", "a x y z"]))
    chunk = Chunk.unpacked(Chunk.of(np.bincount(text), np.ones(2, bool), h, g).packed())
    assert len(chunk.key) == 12 and (chunk.key[chunk.back] == h).all() and (chunk.check[chunk.back] == g).all()


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "a")], "doc_id long, text string")
    assert score_documents(docs.where("false"), F.lit(True)).collect() == []
    got = {r.doc_id: r for r in score_documents(docs, F.lit(None).cast("boolean")).collect()}
    assert len(got) == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].base_score == 0 and got[2].n_tokens == 1


def test_hash_of_ids_is_crc32(spark):
    got = spark.range(5).select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert all(r.c == zlib.crc32(str(r.id).encode()) for r in got)


def test_batches_to_workers_are_bounded(spark, tmp_path, monkeypatch):
    """Rows of n-grams and answers are tens of KB each: without a bound a batch holds 64 MB of them, in the JVM and in the worker."""
    spark.createDataFrame(corpus(), "text string, doc_id long, score double").write.parquet(str(tmp_path / "documents.parquet"))
    before, bounds, plain = spark.conf.getAll.get(storage._BATCH_CONF), [], queries.score_documents
    monkeypatch.setattr(queries, "score_documents", lambda *a: bounds.append(spark.conf.getAll.get(storage._BATCH_CONF)) or plain(*a))
    spark.conf.unset(storage._BATCH_CONF)
    try:
        assert queries.op6_lm_scores(spark, str(tmp_path)).count() == len(corpus())
    finally:
        spark.conf.unset(storage._BATCH_CONF) if before is None else spark.conf.set(storage._BATCH_CONF, before)
    assert bounds == [str(storage.BATCH_BYTES)]


def test_a_step_gives_memory_back(monkeypatch):
    done = []
    monkeypatch.setattr(vectext, "_trim", lambda: done.append(True))
    assert list(vectext.gives_back(lambda it: (x for x in it))(iter([1, 2]))) == [1, 2] and done
