"""A corpus pipeline of the training-data operators: language, near copies, benchmark quotes, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import language_id, secret_scan
from docloom.llm.decontam import drop_contaminated
from docloom.llm.jaccard import jaccard_components, without
from docloom.llm.packing import pack
from docloom.llm.queries import byte_bpe, learned_language_model, tiktoken_vocabulary
from docloom.llm.storage import clear, mark, materialize, small_batches, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose words are told apart by language; those without letters (null texts, too) or without a clear language go.

    Each row is judged by itself, ids play no part: repeated rows all stay or all go. An empty table gives an empty result.
    """
    small_batches(spark)
    return language_id.keep_identified(docs, learned_language_model(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at 0.8 or more: that of the smallest id, of equal ids the first.

    Rows are told apart by a number, not by their id: of repeated rows one stays, rows of equal or null id
    are compared like any others, null ids coming last. Rows with null or blank text are in no group and stay.
    An empty table gives an empty result.
    """
    small_batches(spark)
    row = "row_number"
    while row in docs.columns:
        row += "_"
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    found = jaccard_components(numbered, size=5, num=8, den=10, id_col=row).withColumnRenamed("doc_id", row)
    members = materialize(found.select(row, "component_id").join(numbered.select(row, F.col("doc_id").alias("id")), row), "near-copies")
    best = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", row)).alias("best"))
    copies = materialize(members.join(best.select(f"best.{row}"), row, "left_anti").select(row), "copies")
    return without(numbered, copies, row).select(docs.columns)


def benchmark_quotes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text quotes no benchmark item. Null and empty texts stay, repeated rows all stay or all go."""
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts replaced and n_chars set anew where that changed it. Null texts stay null."""
    small_batches(spark)
    size_col = "n_chars" if "n_chars" in docs.columns else None
    return secret_scan.scrub(docs, *tiktoken_vocabulary(), size_col=size_col)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the kept rows in sequences of 1024 tokens, mixed by source. A null text is an end id, a null source a source."""
    small_batches(spark)
    return pack(docs, byte_bpe())


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark_quotes", benchmark_quotes), ("secrets", secrets), ("packing", packing)]

#: The stages learn a model, take components and run a tokenizer: not SQL. They are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on what the one before kept; a stage's intermediate tables go once it is written."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        clear(spark, since, keep=docs)
    return docs
