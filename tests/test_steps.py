import pyarrow as pa

from docloom.operators import batches, normalize, text_markdown
from docloom.operators.normalize import normalized
from docloom.operators.text_markdown import page_markdown
from docloom.operators.textrules import repair_word_breaks
from docloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def worker(monkeypatch, df, make):
    """The function that an operator gives to Python workers."""
    found = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: found.append(f) or self)
    make(df)
    monkeypatch.undo()
    (f,) = found
    return f


def test_repair_works_in_bounded_steps(spark, monkeypatch):
    """One batch of 8 MB comes back in parts of a step's size, every row in its place; a row above it makes a part of its own."""
    df = spark.createDataFrame([], "doc_id long, text string")
    texts = [f"Gar dening {i} " + "and pot tery " * 80 for i in range(8000)]
    texts[3], texts[5] = None, "ab c " * 500_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array(texts)], ["doc_id", "text"])
    parts = list(worker(monkeypatch, df, text_markdown.with_repaired)(iter([batch])))
    assert len(parts) > 6 and all(p.num_rows == 1 or p.nbytes <= 2.1 * (1 << 20) for p in parts)
    got = pa.Table.from_batches(parts).to_pydict()
    assert got["doc_id"] == list(range(8000)) and got["text"] == texts
    assert got["repaired"] == [None if t is None else repair_word_breaks(t) for t in texts]


def test_steps_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array([["x" * n] for n in (0, 1, 900, 5, 5, 5, 2000, 3)])], ["pages"])
    for limit in (1, 100, 1000, 10_000):
        assert pa.Table.from_batches(batches.steps(batch, limit)).column(0).to_pylist() == batch.column(0).to_pylist()
    assert list(batches.steps(batch.slice(0, 0))) == []


def test_manifest_holds_texts_in_one_worker(spark, monkeypatch):
    """The list's texts are converted and normalised by one Python step, in bounded parts, and only the body comes back."""
    plan = catalogue.txt_manifest(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    df = spark.createDataFrame([], "file_seq long, text string")
    texts = [f"Title {i}\n\n- one  \n- two\n\nsome te xt, " + "more words " * 90 for i in range(4000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(texts)], ["file_seq", "text"])
    parts = list(worker(monkeypatch, df, lambda x: normalize.with_text_body(x, keep=False))(iter([batch])))
    assert len(parts) > 3 and {tuple(p.schema.names) for p in parts} == {("file_seq", "body")}
    assert pa.Table.from_batches(parts).column("body").to_pylist() == [normalized(page_markdown(t)) for t in texts]


def test_markdown_query_sends_no_text_back(spark, monkeypatch):
    """Of a large batch only ids and Markdown come back from the worker, in parts of a step's size."""
    df, found = spark.createDataFrame([], "doc_id long, text string"), []
    plain = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: found.append((f, schema)) or plain(self, f, schema))
    assert catalogue.txt_to_markdown(spark, DATA).columns == ["doc_id", "markdown"]
    ((f, schema),) = found
    assert schema.names == ["doc_id", "markdown"]
    texts = [None, *(f"Plain line {i}\n\n" + "and more of it " * 60 for i in range(4000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4001)), pa.array(texts)], ["doc_id", "text"])
    parts = list(f(iter([batch])))
    assert len(parts) > 3 and {tuple(p.schema.names) for p in parts} == {("doc_id", "markdown")}
    assert pa.Table.from_batches(parts).column("markdown").to_pylist() == [None if t is None else page_markdown(t) for t in texts]
