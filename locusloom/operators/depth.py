"""Read depth per bin and its consensus over samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import genomic_bins


def usable(df: DataFrame, min_mapq: int, skip_duplicates: bool = True, mapq: str = "mapq", dup: str = "is_dup") -> DataFrame:
    """Reads that count: mapping quality reached and, if asked, no duplicates (null flags count as false)."""
    ok = F.col(mapq) >= min_mapq
    return df.where(ok & ~F.coalesce(F.col(dup), F.lit(False))) if skip_duplicates else df.where(ok)


def read_depth(reads: DataFrame, size: int, extra: list[str] | None = None) -> DataFrame:
    """(extra..., ref, bin, tdp, wdp, cdp): reads in all, forward and reverse, per bin that they touch (closed
    ends). One aggregate that combines before its only shuffle."""
    by = [*(extra or []), "ref"]
    hit = reads.where("beg is not null and end >= beg").select(*by, "is_reverse", F.explode(F.expr(f"sequence(beg div {size}, end div {size})")).alias("bin"))
    return hit.groupBy(*by, "bin").agg(F.count("*").alias("tdp"), F.count_if(~F.col("is_reverse")).alias("wdp"), F.count_if(F.col("is_reverse")).alias("cdp"))


def read_depth_all(reads: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """Depth of every bin of every contig, 0 where nothing maps."""
    bins = genomic_bins(contigs, size).withColumn("bin", F.expr(f"beg div {size}"))
    got = read_depth(reads, size)
    out = bins.join(got, ["ref", "bin"], "left")
    return out.select("ref", "beg", "end", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("tdp", "wdp", "cdp")])


def consensus_depth(depths: DataFrame, keys: list[str], samples: int | None = None) -> DataFrame:
    """Mean and population SD of the three depths over the segments at a position."""
    cols = [x for d in ("tdp", "wdp", "cdp") for x in (F.avg(d).alias(f"{d}_mean"), F.stddev_pop(d).alias(f"{d}_sd"))]
    return depths.groupBy(*keys).agg(F.count("*").alias("n"), *cols)


def fold_change(value: Column, base: Column) -> Column:
    return F.try_divide(value.cast("double"), base.cast("double"))


def segment_id(ref: Column, beg: Column, end: Column) -> Column:
    return F.concat(ref, F.lit(":"), beg.cast("string"), F.lit("-"), end.cast("string"))
