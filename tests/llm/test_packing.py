import zlib

import numpy as np
import pytest

from docloom.llm import queries
from docloom.llm.packing import cut, pack, schedule
from docloom.llm.tokens import Encoder


def test_schedule_places_every_token_once():
    rnd = np.random.default_rng(0)
    for _ in range(100):
        n, k = rnd.integers(1, 60), rnd.integers(1, 6)
        size = rnd.integers(1, 80, n)
        pieces = cut(schedule(rnd.integers(0, k, n), size, rnd.random(k), rnd.normal(0, 50, k), int(rnd.integers(5, 200))), 32)
        places = [(d, x) for d, s, length, _, _ in pieces.tolist() for x in range(s, s + length)]
        assert len(places) == len(set(places)) == size.sum()
        assert ((pieces[:, 4] + pieces[:, 2]) <= 32).all()
        assert (pieces[:, 3] * 32 + pieces[:, 4] == np.cumsum(pieces[:, 2]) - pieces[:, 2]).all()


def test_windows_keep_the_shares():
    source = np.repeat([0, 1, 2], 400)
    rows = schedule(source, np.full(1200, 50), np.array([0.5, 0.3, 0.2]), np.zeros(3), 1000)
    pieces = cut(rows, 1000)
    for window in range(15):  # until the largest queue runs dry
        part = pieces[pieces[:, 3] == window]
        got = np.bincount(source[part[:, 0]], weights=part[:, 2], minlength=3)
        assert np.abs(got - [500, 300, 200]).max() <= 1


def test_deficits_carry():
    rows = schedule(np.array([0, 1]), np.array([1000, 1000]), np.array([0.5, 0.5]), np.array([-100.0, 100.0]), 400)
    first = cut(rows, 400)
    assert np.bincount(first[first[:, 3] == 0][:, 0], weights=first[first[:, 3] == 0][:, 2]).tolist() == [100, 300]


@pytest.mark.parametrize("shard_tokens", [1 << 20, 900])
def test_pack(spark, shard_tokens):
    texts = [None, "", "short", "long " * 30000, *("word%d and more " % i * (i * 7 % 90) for i in range(60))]
    rows = [(t, i, None if i % 9 == 0 else f"s{i % 4}", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, source string, length int")
    got = pack(docs, queries.byte_bpe(), shard_tokens=shard_tokens, length=64, window=2).collect()
    library = Encoder(queries.byte_bpe()).library
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    seen = {i: 0 for i in ids}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert seen == {i: len(x) for i, x in ids.items()}
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    ends = []
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        ends.append(at)
    assert max(ends) <= 64 and sum(e < 64 for e in ends) <= len({s >> 32 for s in held})


def test_empty_and_shares(spark):
    schema = "doc_id long, text string, source string"
    assert pack(spark.createDataFrame([], schema), queries.byte_bpe()).collect() == []
    docs = spark.createDataFrame([(i, "a b c " * 40, f"s{i % 2}") for i in range(40)], schema)
    got = pack(docs, queries.byte_bpe(), shares={"s0": 0.75, "s1": 0.25}, length=100, window=4).collect()
    first = [r for r in got if r.sequence_id < 4]
    assert abs(sum(r.length for r in first if r.source == "s0") - 300) <= 1


def test_rows_without_ids_are_dealt_out(spark):
    rows = [(None, "the same words " * 20, "a" if i % 3 else None, "x") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string").repartition(3)
    got = pack(docs, queries.byte_bpe(), shard_tokens=500, length=64, window=2).collect()
    n = len(Encoder(queries.byte_bpe()).library.encode("the same words " * 20).ids) + 1
    assert sum(r.length for r in got) == 200 * n and {r.doc_tokens for r in got} == {n}
    shards = [r.sequence_id >> 32 for r in got]
    assert len(set(shards)) > 20 and max(map(shards.count, set(shards))) < len(shards) / 4


def test_deficits_carry_over_shards_in_tokens(spark):
    rows = [(i, "one two three four five " * 10, "a" if i % 4 else "b") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = pack(docs, queries.byte_bpe(), shard_tokens=4000, length=50, window=4, shares={"a": 0.5, "b": 0.5}).collect()
    held: dict = {}
    for r in got:
        held.setdefault(r.sequence_id >> 32, {}).setdefault(r.source, 0)
        held[r.sequence_id >> 32][r.source] += r.length
    assert len(held) > 3  # every shard starts with what the ones before it owe: b is short everywhere, so b comes first
    for shard in sorted(held)[1:]:
        first = [r.source for r in got if r.sequence_id == shard << 32]
        assert "b" in first or "b" not in held[shard]


def test_totals(spark):
    from docloom.llm.totals import with_before

    rows = [(s, i, (i * 7) % 5) for s in ("x", None) for i in range(0, 60, 2)]
    df = spark.createDataFrame(rows, "source string, n long, v long")
    for by in ([], ["source"]):
        part = df if by else df.where("source = 'x'")
        for block in (4, 4096):
            for r in with_before(part, "n", "v", by, block).collect():
                assert r.before == sum(v for s, i, v in rows if s == r.source and i < r.n)
