"""Positions of rows inside groups of any size, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group that are numbered together.
BLOCK_ROWS = 50_000


def blocks_for(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS))


def with_position(df: DataFrame, group: str, spread: Column, order: list[str], blocks: int, out: str = "position") -> DataFrame:
    """df with the position (from 0) of each row in its group: rows are hashed by `spread` into blocks, numbered
    inside a block in `order`, and shifted by the rows of the blocks before."""
    rows = df.withColumn("__block", F.pmod(F.xxhash64(spread), F.lit(blocks)))
    sizes = rows.groupBy(group, "__block").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("__g"), F.col("__block").alias("__b"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy(group, "__block").orderBy(*order)
    numbered = rows.withColumn("__in", F.row_number().over(inside).cast("bigint") - 1)
    same = numbered[group].eqNullSafe(starts["__g"]) & (numbered["__block"] == starts["__b"])
    return numbered.join(starts, same).withColumn(out, F.col("__start") + F.col("__in")).drop("__block", "__in", "__g", "__b", "__start")
