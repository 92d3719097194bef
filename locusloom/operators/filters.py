"""Named quality filters. All that are asked for are evaluated; a row keeps the names of those it fails, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import EngineConf
from .intervals import overlap_bp, range_join

#: Order in which failures are listed, per kind of cluster.
CLIPPING = ("MIN-NBREADS", "SUPPL-REF", "SUPPL-SRC", "SUPPL-MAPQ", "GERMLINE", "READ-DUP", "CLUSTER-RANGE")
DISCORDANT = ("MIN-NBREADS", "MATE-REF", "MATE-SRC", "MATE-MAPQ", "GERMLINE", "UNSPECIFIC", "READ-DUP", "CLUSTER-RANGE")
META = (
    "MIN-NBREADS", "MAX-NBREADS", "CV", "SV-TYPE", "PERC-RESOLVED", "AREAMAPQ", "AREASMS", "IDENTITY", "GERMLINE", "META-RANGE",
    "ANNOTATION", "SVs-NORMAL", "srcREF-TDs-ref6",
)


def failed(conditions: dict[str, Column], order: tuple[str, ...]) -> Column:
    """array<string> of the names whose condition does not hold (a null condition fails), in `order`."""
    names = [n for n in order if n in conditions]
    return F.array_compact(F.array(*[F.when(~F.coalesce(conditions[n], F.lit(False)), n) for n in names])) if names else F.expr("cast(array() as array<string>)")


def passing(df: DataFrame, col: str = "failed_filters") -> DataFrame:
    return df.where(F.size(col) == 0)


def failing(df: DataFrame, col: str = "failed_filters") -> DataFrame:
    return df.where(F.size(col) > 0)


def read_support(n_reads: Column, n_tumour: Column, n_normal: Column, min_reads: int, min_normal: int) -> tuple[Column, Column]:
    """(passes, origin). With roles: germline if both sides reach their minimum, else somatic of the one that does;
    without roles all reads must reach min_reads and the origin stays null."""
    t, n = n_tumour >= min_reads, n_normal >= min_normal
    with_roles = n_tumour.isNotNull() & n_normal.isNotNull()
    origin = F.when(with_roles & t & n, "germline").when(with_roles & t, "somatic-tumour").when(with_roles & n, "somatic-normal")
    return F.when(with_roles, t | n).otherwise(n_reads >= min_reads), origin


def duplicates_below(n_dup: Column, n: Column, most: float = 75.0) -> Column:
    return F.try_divide(n_dup * F.lit(100.0), n) < most


def spread_discordant(n: Column, beg: Column, end: Column, shortest: Column) -> Column:
    """A cluster of several reads must reach over more than its shortest aligned read."""
    return (n <= 1) | (end - beg > shortest)


def spread_clipping(n: Column, distinct_coords: Column) -> Column:
    """A cluster of several reads must show at least three different read coordinates."""
    return (n <= 1) | (distinct_coords > 2)


def reciprocal_range(orientation: Column, plus: Column, minus: Column, beg: Column, end: Column, most: float = 40.0) -> Column:
    """plus and minus are struct(beg, end) of the two sides: they may share at most `most` per cent of the whole."""
    shared = overlap_bp(plus["beg"], plus["end"], minus["beg"], minus["end"])
    return (orientation != "RECIPROCAL") | (F.try_divide(shared * F.lit(100.0), end - beg) <= most)


def no_close_repeat(annotation: Column, family: str, sub: str, most: int = 0, poly_a: Column | None = None) -> Column:
    """No annotated repeat of the family, its subfamily containing `sub`, within `most` bases; with poly_a given,
    insertions that have a tail pass anyway."""
    hit = F.exists(annotation, lambda r: r["family"].contains(family) & r["subfamily"].contains(sub) & (r["distance"] <= most))
    ok = ~F.coalesce(hit, F.lit(False))
    return ok if poly_a is None else ok | poly_a


def source_on_same_arm(ref: Column, source: Column, poly_a: Column, chrom: str = "chr6") -> Column:
    """On `chrom`, transductions whose source band lies on it too need a tail."""
    src = F.concat(F.lit("chr"), F.get(F.split(F.replace(source, F.lit("p"), F.lit("q")), "q"), F.lit(0)))
    return (ref != chrom) | source.isNull() | (src != ref) | poly_a


def outside(clusters: DataFrame, ranges: DataFrame, key: str, buffer: int = 10_000) -> DataFrame:
    """clusters with `outside`: none of `ranges` (r_ref, r_beg, r_end) lies within buffer."""
    hit = range_join(clusters.select(key, "ref", "beg", "end"), ranges.select("r_ref", "r_beg", "r_end"), buffer).select(key).distinct().withColumn("__hit", F.lit(True))
    return clusters.join(hit, key, "left").withColumn("outside", F.col("__hit").isNull()).drop("__hit")


def area(clusters: DataFrame, reads: DataFrame, key: str, buffer: int = 50, low: int = 10) -> DataFrame:
    """Per cluster the reads around it: n_area, share_low_mapq (mapq <= low), share_clipped (clipped at both ends).
    `reads` has r_ref, r_beg, r_end, mapq and both_clipped."""
    near = range_join(clusters.select(key, "ref", "beg", "end"), reads.select("r_ref", "r_beg", "r_end", "mapq", "both_clipped"), buffer)
    return near.groupBy(key).agg(
        F.count("*").alias("n_area"), (F.count_if(F.col("mapq") <= low) / F.count("*")).alias("share_low_mapq"), (F.count_if("both_clipped") / F.count("*")).alias("share_clipped")
    )


def mate_specificity(clusters: DataFrame, reads: DataFrame, key: str, buffer: int = 200) -> DataFrame:
    """Per cluster (with n_events and its mates' interval as ref, beg, end): events over distinct properly paired
    reads around the mates; null where there are none, which passes."""
    near = range_join(clusters.select(key, "n_events", "ref", "beg", "end"), reads.select("r_ref", "r_beg", "r_end", "read_name"), buffer)
    once = near.groupBy(key, "n_events", "read_name").agg(F.lit(1))
    return once.groupBy(key, "n_events").agg(F.count("*").alias("n_proper")).select(key, (F.col("n_events") / F.col("n_proper")).alias("specificity"))


def weighted_mapq(a: Column, n_a: Column, b: Column, n_b: Column) -> Column:
    """Mean of two means, weighted by their reads."""
    return F.try_divide(F.coalesce(a * n_a, F.lit(0.0)) + F.coalesce(b * n_b, F.lit(0.0)), F.coalesce(n_a, F.lit(0)) + F.coalesce(n_b, F.lit(0)))


# ---- the named sets


def _common(df: DataFrame, conf: EngineConf, normal: str) -> tuple[dict[str, Column], Column]:
    ok, origin = read_support(F.col("n_reads"), F.col("n_tumour"), F.col("n_normal"), conf.min_reads, conf.min_normal_reads)
    return {"MIN-NBREADS": ok, "GERMLINE": F.col(normal) < conf.min_normal_reads}, origin


def _on_target(ref: str, conf: EngineConf) -> Column:
    return F.col(ref).isin(*conf.target_refs) if conf.target_refs is not None else F.lit(True)


def _away(df: DataFrame, key: str, side: str, sources: DataFrame | None, buffer: int) -> DataFrame:
    """df with `__away`: no source element lies within buffer of the interval side_ref, side_beg, side_end."""
    if sources is None:
        return df.withColumn("__away", F.lit(True))
    there = df.select(key, *[F.col(f"{side}_{c}").alias(c) for c in ("ref", "beg", "end")])
    return df.join(outside(there, sources, key, buffer).select(key, F.col("outside").alias("__away")), key)


def _judged(df: DataFrame, tests: dict[str, Column], names: tuple[str, ...], order: tuple[str, ...], origin: Column) -> DataFrame:
    unknown = set(names) - set(order)
    if unknown:
        raise ValueError(f"no such filters: {', '.join(sorted(unknown))}")
    return df.withColumn("origin", origin).withColumn("failed_filters", failed({n: tests[n] for n in names}, order)).drop("__away")


def judge_clippings(df: DataFrame, key: str, conf: EngineConf = EngineConf(), names: tuple[str, ...] = CLIPPING, sources: DataFrame | None = None, buffer: int = 10_000, min_mapq: float = 10.0) -> DataFrame:
    """Clipping clusters with `failed_filters`, the names of `names` that fail, and `origin`. df has n_reads, n_tumour,
    n_normal (distinct reads), n_events, n_normal_events, n_dup, n_coords (distinct read coordinates) and the
    supplementary cluster's suppl_ref, suppl_beg, suppl_end and suppl_mapq. `sources` (r_ref, r_beg, r_end) are the
    elements that SUPPL-SRC keeps away from; without any it passes. A null where a filter needs a value fails it."""
    c = F.col
    tests, origin = _common(df, conf, "n_normal_events")
    tests |= {
        "SUPPL-REF": _on_target("suppl_ref", conf), "SUPPL-SRC": c("__away"), "SUPPL-MAPQ": c("suppl_mapq") >= min_mapq,
        "READ-DUP": duplicates_below(c("n_dup"), c("n_events")), "CLUSTER-RANGE": spread_clipping(c("n_events"), c("n_coords")),
    }
    return _judged(_away(df, key, "suppl", sources if "SUPPL-SRC" in names else None, buffer), tests, names, CLIPPING, origin)


def judge_discordants(
    df: DataFrame, key: str, conf: EngineConf = EngineConf(), names: tuple[str, ...] = DISCORDANT, sources: DataFrame | None = None, buffer: int = 10_000, min_mapq: float = 10.0, least_specific: float = 0.95
) -> DataFrame:
    """As `judge_clippings` for discordant clusters: df has the counts, beg, end, shortest (the least aligned length),
    mate_ref, mate_beg, mate_end, mate_mapq and specificity (of `mate_specificity`; null passes)."""
    c = F.col
    tests, origin = _common(df, conf, "n_normal_events")
    tests |= {
        "MATE-REF": _on_target("mate_ref", conf), "MATE-SRC": c("__away"), "MATE-MAPQ": c("mate_mapq") >= min_mapq,
        "UNSPECIFIC": c("specificity").isNull() | (c("specificity") > least_specific), "READ-DUP": duplicates_below(c("n_dup"), c("n_events")),
        "CLUSTER-RANGE": spread_discordant(c("n_events"), c("beg"), c("end"), c("shortest")),
    }
    return _judged(_away(df, key, "mate", sources if "MATE-SRC" in names else None, buffer), tests, names, DISCORDANT, origin)


def judge_metaclusters(df: DataFrame, conf: EngineConf = EngineConf(), names: tuple[str, ...] = META, max_low_mapq: float = 0.3, max_clipped: float = 0.15, max_in_normal: float = 20.0) -> DataFrame:
    """As `judge_clippings` for metaclusters: df has the counts (n_normal_reads for GERMLINE), cv, sv_type,
    pct_resolved, share_low_mapq and share_clipped (of `area`), identity, orientation with `plus` and `minus`
    (struct(beg, end)), beg, end, `repeats` (array of distance, family, subfamily), poly_a, pct_in_normal and
    source_band (null without a transduction's source). No CV is no spread."""
    c = F.col
    tests, origin = _common(df, conf, "n_normal_reads")
    tail = F.coalesce(c("poly_a"), F.lit(False))
    tests |= {
        "MAX-NBREADS": c("n_events") <= conf.max_reads, "CV": F.coalesce(c("cv"), F.lit(0.0)) <= conf.max_cv, "SV-TYPE": c("sv_type").isin(*conf.target_sv), "PERC-RESOLVED": c("pct_resolved") >= conf.min_resolved,
        "AREAMAPQ": c("share_low_mapq") < max_low_mapq, "AREASMS": c("share_clipped") < max_clipped, "IDENTITY": c("identity").isNotNull(),
        "META-RANGE": reciprocal_range(c("orientation"), c("plus"), c("minus"), c("beg"), c("end")), "ANNOTATION": no_close_repeat(c("repeats"), "L1", "L1PA", 0, tail),
        "SVs-NORMAL": c("pct_in_normal") <= max_in_normal, "srcREF-TDs-ref6": source_on_same_arm(c("ref"), c("source_band"), tail),
    }
    return _judged(df, tests, names, META, origin)


def split_judged(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passing, failing) rows of a judged table."""
    return passing(df), failing(df)
