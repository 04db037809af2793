"""Input files as rows, in path order, and their conversion."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions.dialect import SPARK
from docloom.sources.formats import convert

LISTING = "file_seq long, path string, source_file string, length long"


def list_files(inputs: list[str], recursive: bool = False) -> list[tuple[int, str, str, int]]:
    """(file_seq, path, name, bytes) of files and folders given: no links, nothing hidden, missing ones skipped.

    A folder's files come in path order at the folder's place among the inputs. Files of no bytes are
    listed here, though a binary file scan would not show them.
    """
    found: list[str] = []

    def walk(folder: str) -> None:
        try:
            names = sorted(os.listdir(folder))
        except OSError:
            return
        for name in names:
            path = os.path.join(folder, name)
            if name.startswith(".") or os.path.islink(path):
                continue
            if os.path.isfile(path):
                found.append(path)
            elif recursive and os.path.isdir(path):
                walk(path)

    for given in inputs:
        if os.path.isdir(given):
            walk(given)
        elif os.path.isfile(given) and not os.path.basename(given).startswith("."):
            found.append(given)
    return [(i, os.path.abspath(p), os.path.basename(p), _size(p)) for i, p in enumerate(found)]


def _size(path: str) -> int:
    """A file's bytes, -1 where they can't be told: it then fails by itself, not the job."""
    try:
        return os.path.getsize(path)
    except OSError:
        return -1


def read_files(spark: SparkSession, listing: list[tuple[int, str, str, int]], max_bytes: int = R.MAX_FILE_BYTES) -> DataFrame:
    """The listing with extension, error code and content. What fails by name or size is not read."""
    rows = spark.createDataFrame(listing, LISTING)
    rows = rows.withColumn("source_type", R.column(R.extension, "source_file"))
    rows = rows.withColumn("error_code", F.coalesce(F.expr(R.file_error(SPARK, "source_type", "length", max_bytes)), F.when(F.col("length") < 0, F.lit("CONVERSION_FAILED"))))
    wanted = [p for _, p, name, size in listing if 0 < size <= max_bytes and os.path.splitext(name)[1].lower().lstrip(".") in R.EXTENSIONS]
    # Spark's file index hides names that start with an underscore, however they are given
    odd = [p for p in wanted if os.path.basename(p).startswith("_")]
    content = spark.createDataFrame([(p, _read(p)) for p in odd], "path string, content binary")
    plain = sorted(set(wanted) - set(odd))
    if plain:
        scan = spark.read.format("binaryFile").load([re.sub(r"([\\\[{*?])", r"\\\1", p) for p in plain])
        # file URIs keep their slashes but may gain a scheme, so the file's path is compared without one
        content = content.unionByName(scan.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content"))
    return rows.join(content, "path", "left")


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def convert_files(files: DataFrame, seconds: int = 30, **options) -> DataFrame:
    """file_seq, source_file, source_type, markdown, warning, error_code, raw_data (CSV files' bytes as they are).

    Files are dealt out one by one, as one of them can be as large as the limit.
    """
    schema = "file_seq long, source_file string, source_type string, markdown string, warning string, error_code string, raw_data binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a batch a file bounds what is held
                row = {name: batch.column(name)[i].as_py() for name in ("file_seq", "source_file", "source_type", "error_code", "content")}
                data, markdown, warning, error = row["content"] or b"", None, None, row["error_code"]
                if error is None:
                    markdown, warning, error = convert(row["source_type"], data, seconds, **options)
                raw = data if row["source_type"] == "csv" and error is None else None
                yield pa.RecordBatch.from_pylist([{"file_seq": row["file_seq"], "source_file": row["source_file"], "source_type": row["source_type"], "markdown": markdown, "warning": warning, "error_code": error, "raw_data": raw}], pa.schema([("file_seq", pa.int64()), ("source_file", pa.string()), ("source_type", pa.string()), ("markdown", pa.string()), ("warning", pa.string()), ("error_code", pa.string()), ("raw_data", pa.binary())]))

    return files.repartition("file_seq").mapInArrow(work, schema)
