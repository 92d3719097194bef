"""Per-cluster aggregates. Every one is a plain aggregate with a map-side part; none collects a cluster's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import t_quantile_of

TUMOUR, NORMAL = "TUMOUR", "NORMAL"


def support(df: DataFrame, key: list[str], read: str = "read_name", role: str = "role") -> DataFrame:
    """Distinct reads per cluster: n_reads, n_tumour, n_normal. The latter two are null where a row without a role
    leaves the split unknown."""
    once = df.groupBy(*key, read).agg(
        F.bool_or(F.col(role) == TUMOUR).alias("__t"), F.bool_or(F.col(role) == NORMAL).alias("__n"), F.bool_or(F.col(role).isNull()).alias("__u")
    )
    known = lambda x: F.when(~F.bool_or("__u"), F.count_if(F.coalesce(F.col(x), F.lit(False))))
    return once.groupBy(*key).agg(F.count(read).alias("n_reads"), known("__t").alias("n_tumour"), known("__n").alias("n_normal"))


def event_counts(df: DataFrame, key: list[str], sv_type: str = "sv_type", role: str = "role") -> DataFrame:
    """Events per cluster in all, by role (null where a role is unknown) and by type (others count as clippings)."""
    known = lambda r: F.when(F.count_if(F.col(role).isNull()) == 0, F.count_if(F.col(role) == r))
    kind = F.coalesce(F.col(sv_type), F.lit(""))
    return df.groupBy(*key).agg(
        F.count("*").alias("n_events"), known(TUMOUR).alias("n_tumour"), known(NORMAL).alias("n_normal"),
        F.count_if(kind == "INS").alias("n_ins"), F.count_if(kind == "DEL").alias("n_del"), F.count_if(~kind.isin("INS", "DEL")).alias("n_clipping"),
    )


def level_counts(df: DataFrame, level: str) -> DataFrame:
    """(level, n) per bin level, and a row with a null level for all."""
    return df.rollup(level).agg(F.count("*").alias("n"))


def duplicate_pct(df: DataFrame, key: list[str], dup: str = "is_dup") -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n_events"), (F.count_if(F.col(dup)) * F.lit(100.0) / F.count("*")).alias("dup_pct"))


def length_cv(value: Column) -> tuple[Column, Column]:
    """(mean, CV in per cent with the population SD; null for a mean of 0)."""
    mean = F.avg(value)
    return mean, F.try_divide(F.stddev_pop(value) * F.lit(100.0), mean)


def median_event(df: DataFrame, key: list[str], value: str, tie: str) -> DataFrame:
    """The row of upper-median value per cluster: position ceil((n - 1) / 2), from 0, in order of (value, tie)."""
    rows = df.where(F.col(value).isNotNull())
    # the value is found on counts of distinct values, then its row among those of that value: df is read twice
    counts = rows.groupBy(*key, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*key)
    upto = F.sum("__c").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    at = counts.withColumn("__upto", upto).withColumn("__n", F.sum("__c").over(w)).where(F.expr("__n div 2 < __upto and __n div 2 >= __upto - __c"))
    at = at.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], "__v", F.expr("__n div 2 - (__upto - __c) + 1").alias("__at"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    near = rows.join(at, [*same, F.col(value) == F.col("__v")]).withColumn("__no", F.row_number().over(Window.partitionBy(*key).orderBy(tie)))
    return near.where("__no = __at").select(*df.columns)


def breakpoint_mode(df: DataFrame, key: list[str], pos: str) -> DataFrame:
    """(key, breakpoint, n): the most frequent position; of several, the nearest to the truncated median, then the
    least."""
    counts = df.where(F.col(pos).isNotNull()).groupBy(*key, pos).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key).orderBy(pos)
    whole = Window.partitionBy(*key)
    # the median from counts of distinct positions: no list of a cluster's rows is made
    c = counts.withColumn("__hi", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("n").over(whole))
    lo = F.min(F.when(F.col("__hi") >= F.expr("(__n + 1) div 2"), F.col(pos))).over(whole)
    hi = F.min(F.when(F.col("__hi") >= F.expr("__n div 2 + 1"), F.col(pos))).over(whole)
    c = c.withColumn("__median", ((lo + hi) / 2).cast("bigint"))
    best = c.groupBy(*key).agg(F.min_by(F.struct(F.col(pos).alias("b"), "n"), F.struct(-F.col("n"), F.abs(F.col(pos) - F.col("__median")), F.col(pos))).alias("m"))
    return best.select(*key, F.col("m.b").alias("breakpoint"), F.col("m.n").alias("n"))


def side_breakpoints(df: DataFrame, key: list[str], side: str = "clipped_side", pos: str = "clip_pos") -> DataFrame:
    """(key, bkp_left, bkp_right): mode of the clipping positions on each side, least of equals."""
    counts = df.groupBy(*key, side, pos).agg(F.count("*").alias("n"))
    pick = lambda s: F.min_by(F.when(F.col(side) == s, F.col(pos)), F.when(F.col(side) == s, F.struct(-F.col("n"), F.col(pos))))
    return counts.groupBy(*key).agg(pick("left").alias("bkp_left"), pick("right").alias("bkp_right"))


def mean_position(df: DataFrame, key: list[str], pos: str, level: float = 0.95) -> DataFrame:
    """(key, mean_pos, ci_low, ci_high): truncated mean and the offsets, truncated toward zero, of Student's t
    interval around it; no spread or a single row gives the mean itself (offsets 0)."""
    g = df.groupBy(*key).agg(F.avg(pos).alias("__m"), F.stddev_samp(pos).alias("__s"), F.count(pos).alias("__n"))
    q = t_quantile_of(F.col("__n") - 1, 0.5 + level / 2)
    half = q * F.col("__s") / F.sqrt("__n")
    half = F.when((F.col("__n") > 1) & (F.col("__s") > 0), half).otherwise(F.lit(0.0))
    mean = F.col("__m").cast("bigint")
    return g.select(*key, mean.alias("mean_pos"), F.round(F.col("__m") - half - mean, 6).cast("bigint").alias("ci_low"), F.round(F.col("__m") + half - mean, 6).cast("bigint").alias("ci_high"))


def merge_fragments(df: DataFrame, key: list[str], beg: str = "beg", end: str = "end", size: str = "len", tie: str = "event_id") -> DataFrame:
    """One insertion per key from its fragments in order of (beg, tie): where the first and last begin alike the
    first one's size stands, else the span from the first begin to the last end plus all sizes."""
    first, last = F.min_by(size, F.struct(beg, tie)), F.max_by(end, F.struct(beg, tie))
    merged = F.when(F.min(beg) == F.max(beg), first).otherwise(last - F.min(beg) + F.sum(size))
    return df.groupBy(*key).agg(F.min(beg).alias("beg"), last.alias("end"), merged.alias("len"), F.count("*").alias("n_fragments"))


def unanimous(value: Column, a: str, b: str, both: str) -> Column:
    """a or b if all values agree on it, else `both`."""
    return F.when(F.bool_and(value == a), a).when(F.bool_and(value == b), b).otherwise(both)


def clip_orientation(side: Column) -> Column:
    """RECIPROCAL with clippings on both sides, PLUS with right ones only, MINUS with left ones only."""
    left, right = F.bool_or(side == "left"), F.bool_or(side == "right")
    return F.when(left & right, "RECIPROCAL").when(right, "PLUS").when(left, "MINUS")


def majority_identity(df: DataFrame, key: list[str], orientation: str, identity: str, least: float = 0.1) -> DataFrame:
    """(key, orientation, identity, share): the most frequent identity per orientation, if its share exceeds
    `least`; equal counts go to the lesser name."""
    n = df.groupBy(*key, orientation, identity).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key, orientation)
    shares = n.withColumn("share", F.col("n") / F.sum("n").over(w)).where(F.col(identity).isNotNull())
    best = shares.groupBy(*key, orientation).agg(F.min_by(F.struct(identity, "share"), F.struct(-F.col("n"), F.col(identity))).alias("m"))
    return best.select(*key, orientation, f"m.{identity}", "m.share").where(F.col("share") > least)


def sv_type(kinds: Column) -> Column:
    """The type that a metacluster's sub-cluster kinds state: INS, DEL or both as they are, both clipping sides an
    insertion, one side a break-end, else null."""
    has = lambda k: F.array_contains(kinds, k)
    return (
        F.when(has("INS") & has("DEL"), F.lit(None).cast("string"))
        .when(has("INS"), "INS")
        .when(has("DEL"), "DEL")
        .when(has("LEFT-CLIPPING") & has("RIGHT-CLIPPING"), "INS_noOverlap")
        .when(has("LEFT-CLIPPING") | has("RIGHT-CLIPPING"), "BND")
    )


def event_kind(sv: Column, side: Column, orientation: Column) -> Column:
    """Type of an event with its side or orientation in front where it has one."""
    return (
        F.when(sv == "CLIPPING", F.concat(F.upper(side), F.lit("-CLIPPING"))).when(sv == "DISCORDANT", F.concat(orientation, F.lit("-DISCORDANT"))).otherwise(sv)
    )


def merge_grouped(frames: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """Several (key, value) tables as one (key, n, distinct values) table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    once = out.groupBy(*key, value).agg(F.count("*").alias("__n"))
    return once.groupBy(*key).agg(F.sum("__n").alias("n"), F.count(value).alias("n_distinct"))


def override(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full outer union of two keyed tables in which b's value stands where both have the key."""
    x, y = a.select(*key, F.col(value).alias("__a")), b.select(*key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    return x.join(y, key, "full").select(*key, F.when(F.col("__in_b"), F.col("__b")).otherwise(F.col("__a")).alias(value))


def lead_variant(df: DataFrame, key: list[str], platform: str = "platform", sample: str = "sample", order: str = "variant_id", first: str = "HIFI") -> DataFrame:
    """Per cluster of variants its lead (the first of the preferred platform, else the first), all platforms and
    all samples in order."""
    rank = F.struct(F.when(F.col(platform) == first, 0).otherwise(1), F.col(order))
    return df.groupBy(*key).agg(
        F.min_by(order, rank).alias("lead_id"), F.min_by(sample, rank).alias("lead_sample"),
        F.array_join(F.array_sort(F.collect_set(platform)), ",").alias("platforms"), F.array_join(F.array_sort(F.collect_set(sample)), ",").alias("samples"),
    )
