"""Ordinals within a key, without one task for all rows of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of the order in one block.
BLOCK = 65536


def with_ordinal(rows: DataFrame, keys: DataFrame, by: str, order: str, name: str, block: int = BLOCK) -> DataFrame:
    """rows with a column name: the place, from 1, of each among the rows of equal `by`, in the order of an integer column.

    keys holds the same rows' `by` and order columns, from where they are cheap to read. Rows are counted by
    blocks of the order; only these counts, one for each block of a key, are summed up in one task. Rows of
    equal order get ordinals in any order; those of a null key or null order are numbered like any others,
    null orders first.
    """
    at = F.floor(F.col(order) / F.lit(block))
    counts = keys.groupBy(F.col(by).alias("_by"), at.alias("_at")).count()
    earlier = F.sum("count").over(Window.partitionBy("_by").orderBy("_at")) - F.col("count")
    starts = counts.select("_by", "_at", earlier.alias("_earlier"))
    rows = rows.withColumn("_block", at)
    rows = rows.withColumn(name, F.row_number().over(Window.partitionBy(by, "_block").orderBy(order)))
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col("_block").eqNullSafe(F.col("_at"))
    return rows.join(starts, same).withColumn(name, (F.col(name) + F.col("_earlier")).cast("long")).drop("_block", "_by", "_at", "_earlier")
