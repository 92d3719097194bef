"""Scans along an ordered axis that no task runs through from end to end.

Rows are cut into shards of the axis. What a shard has to know of the rows before it is one value per shard (the
greatest reach so far, the number of runs so far), so only a table of shards is scanned per key; the rows themselves
are shuffled once, by key and shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shards that the range of the data is cut into, at most.
SHARDS = 1024
_BEFORE = (Window.unboundedPreceding, -1)


def axis_bits(df: DataFrame, pos: str, shards: int = SHARDS) -> tuple[int, int, int]:
    """(bits, first, last): shards 2^bits wide of the column's range, whatever its unit; one aggregate."""
    lo, hi = df.agg(F.min(pos).cast("bigint"), F.max(pos).cast("bigint")).first()
    if lo is None:
        return 0, 0, 0
    bits = ((hi - lo) // shards).bit_length()
    return bits, lo >> bits, hi >> bits


def number_runs(
    df: DataFrame,
    keys: list[str],
    pos: str,
    tie: list[str],
    reach: Column,
    starts: Callable[[Column], Column],
    out: str,
    bits: int | None = None,
) -> DataFrame:
    """df with bigint `out`: the number (from 1) of each row's run among the rows of its keys in order of (pos, tie).

    `starts` says of a row whether it begins a run, given the greatest `reach` of all rows of its keys before it (null
    for the first); a null answer continues the run. The result is that of a window over each key. Rows of null pos
    come first; null keys are keys of their own; repeated rows that tie in all of `tie` may change places. `bits`
    fixes the width of a shard at 2^bits; without it one aggregate fits it to the range of the data.
    """
    if bits is None:
        bits = axis_bits(df, pos)[0]
    shard = F.coalesce(F.shiftright(F.col(pos).cast("bigint"), bits), F.lit(-(1 << 63)).cast("bigint"))
    rows = df.select(
        F.struct(*[F.col(k) for k in keys], F.lit(0)).alias("__g"), shard.alias("__shard"), F.lit(1).alias("__row"), reach.alias("__reach"), F.struct("*").alias("__r"),
        *[F.col(c).alias(f"__o{i}") for i, c in enumerate((pos, *tie))],
    )
    along = Window.partitionBy("__g").orderBy("__shard").rowsBetween(*_BEFORE)
    per = rows.groupBy("__g", "__shard").agg(F.max("__reach").alias("__reach"))
    # a row in front of each shard brings what the earlier shards reach
    carry = per.select("__g", "__shard", F.lit(0).alias("__row"), F.max("__reach").over(along).alias("__reach")).where("__reach is not null")
    both = rows.unionByName(carry, allowMissingColumns=True)
    inside = Window.partitionBy("__g", "__shard").orderBy("__row", *[f"__o{i}" for i in range(1 + len(tie))])
    before = F.max("__reach").over(inside.rowsBetween(*_BEFORE))
    flagged = both.withColumn("__before", before).where("__row = 1").withColumn("__start", F.when(starts(F.col("__before")), F.lit(1)).otherwise(0).cast("bigint"))
    runs = flagged.groupBy("__g", "__shard").agg(F.sum("__start").alias("__runs"))
    offset = runs.select("__g", "__shard", F.coalesce(F.sum("__runs").over(along), F.lit(0).cast("bigint")).alias("__offset"))
    numbered = flagged.withColumn("__upto", F.sum("__start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    got = numbered.join(offset, ["__g", "__shard"]).withColumn("__no", F.col("__upto") + F.col("__offset"))
    return got.select("__r.*", F.col("__no").alias(out))


def place(df: DataFrame, keys: list[str], pos: str, tie: list[str], out: str = "place", bits: int | None = None) -> DataFrame:
    """df with the place (from 1) of each row among those of its keys in order of (pos, tie)."""
    return number_runs(df, keys, pos, tie, F.lit(0), lambda before: F.lit(True), out, bits)
