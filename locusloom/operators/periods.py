"""Continuous periods and gaps of overlapping intervals, per entity, in two levels.

Level one clips every interval into shards of equal width and merges inside each shard; level two sees only the
first and last period of each shard and stitches those that touch across shard boundaries. No task ever holds an
entity: the largest unit of level one is one shard, that of level two two rows per shard of an entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import SHARDS


def periods_and_gaps(df: DataFrame, keys: list[str], beg: str, end: str, width: int | None = None, shards: int = SHARDS) -> DataFrame:
    """Rows (keys..., kind, beg, end) of the maximal covered periods and of the gaps between neighbours.

    Intervals are half-open; those that touch belong to one period. Rows without an interval (null bound,
    end <= beg) are ignored; null keys form an entity of their own; repeated rows change nothing; an empty input
    gives an empty result; columns other than keys, beg and end are not read, so their names cannot clash.
    Shards are as wide as the power of two from `width` on. Without a width one aggregate over the bounds fits it to
    the range of the data, so that there are about `shards` of them at most whatever the unit of the positions.
    """
    k = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(beg).cast("bigint").alias("__b"), F.col(end).cast("bigint").alias("__e")
    ).where("__b is not null and __e is not null and __e > __b")
    if width is not None:
        bits = (width - 1).bit_length()
    else:
        low, high = rows.agg(F.min("__b"), F.max("__e")).first()
        bits = 0 if low is None else ((high - low) // shards).bit_length()

    lo, hi = f"shiftleft(__s, {bits})", f"shiftleft(__s, {bits}) + {(1 << bits) - 1}"  # first and last position of a shard
    clipped = (
        rows.withColumn("__s", F.explode(F.expr(f"sequence(shiftright(__b, {bits}), shiftright(__e - 1, {bits}))")))
        .select(*k, "__s", F.expr(f"greatest(__b, {lo})").alias("__b"), F.expr(f"least(__e - 1, {hi}) + 1").alias("__e"))
        # one row per begin: combines before the shuffle and bounds a shard at its width
        .groupBy(*k, "__s", "__b")
        .agg(F.max("__e").alias("__e"))
    )
    w = Window.partitionBy(*k, "__s").orderBy("__b")
    before = F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = (
        clipped.withColumn("__new", (before.isNull() | (F.col("__b") > before)).cast("int"))
        .withColumn("__isle", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*k, "__s", "__isle")
        .agg(F.min("__b").alias("__b"), F.max("__e").alias("__e"))
    )
    wi = Window.partitionBy(*k, "__s").orderBy("__isle")
    parts = merged.select(
        *k, "__s", "__b", "__e", F.lead("__b").over(wi).alias("__next"), (F.col("__isle") == 1).alias("__first")
    ).select(
        *k,
        "__s",
        F.explode(
            F.expr(
                "filter(array("
                "if(__next is not null, struct('gap' as kind, __e as b, __next as e), null),"
                "struct(if(__first or __next is null, 'edge', 'period') as kind, __b as b, __e as e)), x -> x is not null)"
            )
        ).alias("p"),
    ).select(*k, "__s", "p.kind", "p.b", "p.e")
    inner = parts.where("kind <> 'edge'").select(*k, "kind", "b", "e")
    we = Window.partitionBy(*k).orderBy("__s", "b")
    edges = (
        parts.where("kind = 'edge'")
        .withColumn("__pe", F.lag("e").over(we))
        .withColumn("__ps", F.lag("__s").over(we))
        .withColumn("__chain", F.sum(F.expr("if(__pe is null or b > __pe, 1, 0)")).over(we.rowsBetween(Window.unboundedPreceding, 0)))
    )
    # one pass over the edges gives their chains and, between shards, the gaps
    stitched = (
        edges.groupBy(*k, "__chain")
        .agg(F.min("b").alias("b"), F.max("e").alias("e"), F.min_by(F.struct("__pe", "__ps", "__s"), F.struct("__s", "b")).alias("f"))
        .select(
            *k,
            F.explode(
                F.expr(
                    "filter(array(struct('period' as kind, b, e),"
                    "if(f.__ps < f.__s, struct('gap' as kind, f.__pe as b, b as e), null)), x -> x is not null)"
                )
            ).alias("p"),
        )
        .select(*k, "p.kind", "p.b", "p.e")
    )
    out = inner.unionByName(stitched)
    return out.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], "kind", F.col("b").alias("beg"), F.col("e").alias("end_pos"))
