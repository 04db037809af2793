import glob
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from docloom.llm import queries, token_files, tokens, vectext
from docloom.llm.storage import new_path
from docloom.llm.token_fst import Composed, Counter, StateMap, count_tokens, reduced
from docloom.llm.tokens import Encoder

ALPHABET = " \n\t'strevmldabX9é٣$! 　ß"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    made = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    return [*made, "", "'", "a<|endoftext|>b c", "<|endoftext|>", "日本語 テキスト 😀😀 ﷽", "x" * 3000, "the " * 5000, "  " * 500]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(queries.byte_bpe())


def test_ids_equal_the_library(encoder, texts):
    ids, count = encoder.encode(texts)
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want


@pytest.mark.parametrize("chunk", [1 << 16, 50, 7])
def test_counts_equal_the_library(encoder, texts, chunk):
    want = [len(e.ids) for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert Counter(queries.byte_bpe()).count(texts, chunk).tolist() == want


@pytest.mark.parametrize("chunk", [1, 5, 23])
def test_state_maps(texts, chunk):
    counter = Counter(queries.byte_bpe())
    long = "".join(t for t in texts[:200] if "<" not in t)
    for text in (long, "".join(long.split()), "x" * 200, "abcdefghij" * 30, "日本語テキスト" * 20):
        maps = counter.maps(text, chunk)
        assert len(maps) == -(-len(text.encode()) // chunk)
        # every map agrees with reading on byte by byte, whatever the state it starts from
        state, total = 0, 0
        for m in maps:
            state, change = m(state)
            total += change
        assert (total,) == tuple(counter.plain([text])) and reduced(maps)(0) == (state, total)
        for a, b, c in list(zip(maps, maps[1:], maps[2:], strict=False))[:60]:
            for s in {0, maps[0](0)[0], maps[len(maps) // 2](0)[0]}:
                assert Composed(Composed(a, b), c)(s) == Composed(a, Composed(b, c))(s)


def test_a_state_map_is_right_for_every_state(texts):
    counter = Counter(queries.byte_bpe())
    counter.plain(texts[:300])
    machine, heads = counter.machine, [b"tion of", b"s", b"", b"xqzxqz" * 5]
    for state in range(0, len(machine.states), 7):
        for head in heads:
            assert StateMap(machine, head, None)(state) == machine.run(state, head)
            assert StateMap(machine, head, (3, 5))(state) == (3, machine.run(state, head)[1] + 5)


def thue_morse(a, b, n):
    """Strings of n letters that every polynomial hash modulo 2^64 mixes up with the one of a and b exchanged."""
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


def test_strings_made_to_collide(encoder):
    texts = [thue_morse(*p, n) for n in (64, 256, 1024, 2048, 4096) for p in ("ab", "ba", "XY", "YX")]
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    for order in (texts, texts[::-1]):
        fresh = Encoder(queries.byte_bpe())
        for group in ([order], [[t] for t in order]):  # together, and one after the other
            got = [x.tolist() for g in group for ids, count in [fresh.encode(g)] for x in np.split(ids, np.cumsum(count)[:-1])]
            assert got == (want if order is texts else want[::-1])
    assert Counter(queries.byte_bpe()).count(texts).tolist() == [len(w) for w in want]


def test_a_shared_first_hash_is_noticed(encoder, texts, monkeypatch):
    plain = vectext.span_hash
    monkeypatch.setattr(vectext, "span_hash", lambda *a: (plain(*a)[0] % np.uint64(50), plain(*a)[1]))
    want = [e.ids for e in encoder.library.encode_batch(texts[:400], add_special_tokens=False)]
    fresh, counter = Encoder(queries.byte_bpe()), Counter(queries.byte_bpe())
    for part in (slice(0, 200), slice(200, 400)):
        ids, count = fresh.encode(texts[part])
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want[part]
        assert counter.count(texts[part], 9).tolist() == [len(w) for w in want[part]]


def test_a_full_memory_forgets_what_came_once(encoder, texts, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 60)
    fresh, most = Encoder(queries.byte_bpe()), 0
    for part in (texts[i : i + 40] for i in range(0, 1200, 40)):
        ids, count = fresh.encode([*part, "the words that come every time"])
        want = [e.ids for e in encoder.library.encode_batch([*part, "the words that come every time"], add_special_tokens=False)]
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == want
        most = max(most, len(fresh.known.memo.key))
    assert most < 1000


def test_other_tokenizers_are_refused():
    import public_tokenizers

    for make in (Encoder, Counter):
        with pytest.raises(ValueError):
            make(public_tokenizers.path("word_bpe_49k.json"))


def test_file_format(spark, texts):
    path = new_path(spark, "test-token-files").removeprefix("file://")
    token_files.write_tokens(rows(spark, texts), "file://" + path, queries.byte_bpe())
    file = pq.ParquetFile(sorted(glob.glob(f"{path}/part-*"))[0])
    group = file.metadata.row_group(0)
    columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids"].encodings or "PLAIN_DICTIONARY" in columns["ids"].encodings
    for name in ("doc_id", "local_start", "n_tokens"):
        assert any(e.startswith("DELTA") for e in columns[name].encodings), columns[name].encodings
        assert columns[name].has_column_index and columns[name].has_offset_index
    # a selective read: the plan fetches the metadata columns only, with the filter pushed into the scan
    some = token_files.read_tokens(spark, "file://" + path).where("doc_id = 7").select("doc_id", "n_tokens")
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "doc_id" in line)
    assert "EqualTo(doc_id,7)" in scan and "ids" not in scan.split("ReadSchema")[1]


def rows(spark, texts):
    extra = [(None, 5000, "x", 1), (None, 5001, "y", 2)]
    return spark.createDataFrame([(t, i, "z", 3) for i, t in enumerate(texts)] + extra, "text string, doc_id long, ids string, part int")


def test_files_read_back(spark, encoder, texts):
    docs = rows(spark, texts)
    path = new_path(spark, "test-token-files")
    token_files.write_tokens(docs.repartition(5), path, queries.byte_bpe())
    got = sorted(map(tuple, token_files.digests(token_files.read_tokens(spark, path)).collect()))
    want, start = [], 0
    for i, t in [*enumerate(texts), (5000, ""), (5001, "")]:
        ids = np.array([*encoder.library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    path = new_path(spark, "test-token-files")
    token_files.write_tokens(docs, path, queries.byte_bpe())
    assert token_files.digests(token_files.read_tokens(spark, path)).collect() == []
    assert count_tokens(docs, queries.byte_bpe()).collect() == []


def test_count_rows(spark, encoder, texts):
    got = {r.doc_id: r for r in count_tokens(rows(spark, texts), queries.byte_bpe()).collect()}
    assert len(got) == len(texts) + 2 and got[5000][1:] == (0, 0, False)
    for i, t in enumerate(texts):
        n = len(encoder.library.encode(t, add_special_tokens=False).ids)
        assert got[i][1:] == (len(t.encode()), n, n > 512)


def test_a_worker_holds_one_large_thing():
    made = []
    make = lambda x: lambda: made.append(x) or [x]
    batch = pa.record_batch({"text": ["a", "b"]})
    one = vectext.kept("one", make(1))
    assert vectext.kept("one", make(1)) is one and made == [1]
    assert len(list(vectext.steps(iter([batch]), keeps=True))) == 1 and vectext.kept("one", make(1)) is one
    vectext.kept("two", make(2))
    assert vectext.kept("one", make(1)) is not one and made == [1, 2, 1]
    assert len(list(vectext.steps(iter([batch])))) == 1 and vectext.kept("one", make(1)) and made == [1, 2, 1, 1]
