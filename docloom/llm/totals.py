"""Running totals over a numbered table, without a window over all of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in one block; one task takes the blocks' totals of a group, a row for each block.
BLOCK = 4096


def with_before(rows: DataFrame, number: str, value: str, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """rows with a column `before`: the sum of value over the rows of smaller number (of equal `by` columns; null equals null).

    Numbers are unique within their group. Rows are summed within blocks of numbers first, then the blocks' totals.
    """
    rows = rows.withColumn("_block", F.floor(F.col(number) / F.lit(block)))
    inner = F.sum(value).over(Window.partitionBy(*by, "_block").orderBy(number)) - F.col(value)
    totals = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_total"))
    outer = F.sum("_total").over(Window.partitionBy(*by).orderBy("_block")) - F.col("_total")
    starts = totals.select(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_block").alias("_at"), outer.alias("_start"))
    same = F.col("_block") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = rows.withColumn("_inner", inner).join(starts, same)
    return out.withColumn("before", F.col("_inner") + F.col("_start")).drop("_block", "_at", "_start", "_inner", *(f"_by_{c}" for c in by))
