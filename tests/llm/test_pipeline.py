import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import queries, storage
from docloom.llm.tokens import Encoder

SYLLABLES = {"en": ["th", "er", "ing", "on", "and"], "de": ["sch", "ung", "eit", "ich", "au"]}


def sentence(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def corpus(spark, folder):
    rnd = random.Random(9)
    rows, items = [], [(i, sentence(rnd, "en", 30)) for i in range(4)]
    for i in range(60):
        lang = "de" if i % 3 == 0 else "en"
        rows.append([i, sentence(rnd, lang, rnd.randint(40, 120)), lang, f"src{i % 3}"])
    rows[10][1] += " token = 'abcdef0123456789' and more"
    rows[20][1] = rows[20][1][:80] + " " + items[1][1].upper() + " " + rows[20][1][80:]
    rows += [[100, rows[5][1], "en", "src1"], [101, rows[6][1] + " extra", "de", "src2"], [102, "12345 !!", "en", "src0"], [103, None, "en", "src0"], [104, "", None, None]]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {r[0]: r[1] for r in rows}


def test_stages(spark, tmp_path):
    texts = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept, columns = set(texts), docs.columns
    gone = {"language": {102, 103, 104}, "near_copies": {100, 101}, "benchmark_quotes": {20}, "secrets": set()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        kept -= gone[name]
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} == kept
    changed = {r.doc_id: (r.text, r.n_chars) for r in docs.collect() if r.text != texts[r.doc_id]}
    assert list(changed) == [10] and "[secret]" in changed[10][0] and "abcdef0123456789" not in changed[10][0] and changed[10][1] == len(changed[10][0])

    final = {r.doc_id: r.text for r in docs.collect()}
    library = Encoder(queries.byte_bpe()).library
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in final.items()}
    got: dict = {}
    for r in pieces:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total and max(r.offset + r.length for r in pieces) <= 1024


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_number string"


def odd_rows():
    rnd = random.Random(3)
    a, b, c = (sentence(rnd, "en", 80) for _ in range(3))
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (2, a, "en", "s"), (2, a, "en", "s"), (None, a + " more", "en", None), (None, c, "en", "s"), (None, c, "en", "s"), (5, c, None, "s"), (6, None, "en", "s"), (6, None, "en", "s"), (7, " ", "en", "s")]
    rows += [(20 + i, sentence(rnd, "de" if i % 2 else "en", 60), "de" if i % 2 else "en", "s") for i in range(30)]
    return [(*r, len(r[1]) if r[1] else None, "own") for r in rows], (a, b, c)


def test_near_copies_by_row(spark, tmp_path):
    rows, (a, b, c) = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    # one row of each group, the smallest id's, and no unique text goes for the sake of its id
    assert sorted((i, t) for i, t in got if t in (a, b, c)) == sorted([(1, a), (1, b), (5, c)])
    assert got.count((6, None)) == 2 and got.count((7, " ")) == 1 and len(got) == 3 + 3 + 30
    assert {r.row_number for r in kept.collect()} == {"own"}


def test_every_stage_takes_odd_rows(spark, tmp_path):
    rows, (a, b, c) = odd_rows()
    items = spark.createDataFrame([(1, b[:200]), (1, None), (None, a)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    names = dict(corpus_pipeline.STAGES)
    got = {name: names[name](spark, docs, str(tmp_path)) for name in names}
    assert all(got[n].columns == docs.columns for n in list(names)[:-1])
    assert sorted(x.text for x in got["language"].collect()) == sorted(r[1] for r in rows if r[1] and r[1].strip())
    assert sorted(x.text or "" for x in got["benchmark_quotes"].collect()) == sorted(r[1] or "" for r in rows if r[1] != b)
    assert sorted(map(str, got["secrets"].collect())) == sorted(map(str, docs.collect()))
    assert sum(r.length for r in got["packing"].collect()) == sum(r.doc_tokens for r in got["packing"].collect() if r.start == 0) and got["packing"].where("start = 0").count() == len(rows)
    none = docs.where("false")
    assert all(stage(spark, none, str(tmp_path)).collect() == [] for stage in names.values())


def test_very_long_and_blank_texts(spark, tmp_path):
    rnd = random.Random(5)
    long = " ".join(sentence(rnd, "en", 40) for _ in range(1500))
    rows = [(1, long, "en", "s", 1, "x"), (2, long + " end", "en", "s", 1, "x"), (3, "x" * 300000, "en", "s", 1, "x"), (4, "", "en", "s", 0, "x")]
    rows += [(10 + i, sentence(rnd, "en", 30), "en", "s", 1, "x") for i in range(20)]
    spark.createDataFrame([(1, "quoted nowhere at all in these texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(corpus_pipeline.near_copies(spark, docs, str(tmp_path))) == ids(docs) - {2}
    assert 4 not in ids(corpus_pipeline.language(spark, docs, str(tmp_path)))
    assert ids(corpus_pipeline.benchmark_quotes(spark, docs, str(tmp_path))) == ids(docs) == ids(corpus_pipeline.secrets(spark, docs, str(tmp_path)))
    total = {r.doc_id: r.doc_tokens for r in corpus_pipeline.packing(spark, docs, str(tmp_path)).collect()}
    library = Encoder(queries.byte_bpe()).library
    assert total == {r[0]: len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows}


def test_batches_to_workers_are_bounded(spark):
    before = spark.conf.getAll.get(storage._BATCH_CONF)
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("text"))
    sizes = lambda: [r.n for r in rows.mapInArrow(lambda bs: (pa.record_batch({"n": [b.nbytes]}) for b in bs), "n long").collect()]
    try:
        spark.conf.set(storage._BATCH_CONF, str(1 << 20))
        storage.small_batches(spark)
        assert spark.conf.get(storage._BATCH_CONF).rstrip("b") == str(1 << 20)  # the session's own bound stays
        spark.conf.unset(storage._BATCH_CONF)
        storage.small_batches(spark)
        assert len(sizes()) > 1 and max(sizes()) < 1.1 * storage.BATCH_BYTES
    finally:
        spark.conf.unset(storage._BATCH_CONF)
        if before:
            spark.conf.set(storage._BATCH_CONF, before)
