"""Uploads that land in a folder, converted as a stream: the same steps, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions.dialect import SPARK
from docloom.sources.files import convert_files

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """The landing folder as a stream of accepted files: allowed types, not empty, within the size limit."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    files = files.select("path", "length", "content", F.expr(R.sanitized(SPARK, "path")).alias("source_file")).where(~name.startswith("."))
    files = files.withColumn("source_type", R.column(R.extension, "source_file"))
    return files.where(F.col("source_type").isin(*R.EXTENSIONS) & F.col("length").between(1, R.MAX_FILE_BYTES))


def convert_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, **options):
    """Start a query that appends converted files to a Parquet table; each micro-batch is written once by its number."""

    def write(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumns({"file_seq": F.xxhash64("path"), "error_code": F.lit(None).cast("string")})
        made = convert_files(keyed, **options).withColumn("status", R.column(R.status, "error_code", "warning"))
        made.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return uploads(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
