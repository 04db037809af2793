"""Token-id files: Parquet with one row a document, in ascending id order over the files.

`ids` is a dictionary-encoded list column; the document's id and place are delta-encoded. Row groups
and pages are small and carry column indexes, so that a reader can fetch the metadata alone, or the
tokens of some documents. A file knows its own order number (`part`) and each document's place in
the file (`local_start`); the place in the whole corpus needs only the files' totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder, with_end
from .totals import with_before
from .vectext import steps

FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0) -> None:
    """Encode every whole text and write the files; a null text counts as empty, and every row is kept.

    Rows of equal id are ordered by their text's hash, then by text, and may lie in several files, unless
    their texts are equal, too. A null id comes first. An empty table gives an empty file set. Other
    columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in steps(batches, keeps=True):
            ids, count = encoder(tokenizer).encode([t or "" for t in batch.column("text").to_pylist()])
            if end_id is not None:
                ids, offsets = with_end(ids, count, end_id)
            else:
                offsets = np.concatenate([[0], np.cumsum(count)])
            size, n = np.diff(offsets), batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), batch.column("doc_id"), pa.array(offsets[:-1] + total), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                ["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
            total += int(offsets[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**FORMAT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids.

    The files' totals are read from their metadata columns; one row of 12 bytes for each file is broadcast.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = with_before(totals, "part", "total").select("part", "before")
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the ids read back."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            at = column.offsets.to_numpy()
            flat = memoryview(column.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
