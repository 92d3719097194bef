"""Structural variants per cell and chromosome: windows, groups, breakage patterns, enrichment and clustering tests."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import fisher_exact, ks_two_sample, normal_density
from .clustering import islands

KEYS = ["cell_id", "ref"]


def window_counts(df: DataFrame, size: int, least: int, keys: list[str] = KEYS) -> DataFrame:
    """(keys, window, n_sv): every window an SV spans, kept if it holds at least `least`."""
    hit = df.select(*keys, F.explode(F.expr(f"sequence(beg div {size}, end div {size})")).alias("window"))
    return hit.groupBy(*keys, "window").agg(F.count("*").alias("n_sv")).where(F.col("n_sv") >= least)


def distances(df: DataFrame, order: list[str], keys: list[str] = KEYS, out: str = "distance") -> DataFrame:
    """Gap from each SV's end to the next one's begin; null for the last."""
    return df.withColumn(out, F.lead("beg").over(Window.partitionBy(*keys).orderBy(*order)) - F.col("end"))


def median_distance(df: DataFrame, order: list[str], keys: list[str] = KEYS) -> DataFrame:
    return distances(df, order, keys).groupBy(*keys).agg(F.median("distance").alias("median_distance"), F.count("*").alias("n_sv"))


def group_adjacent(df: DataFrame, max_dist: int, order: list[str], same: list[str] | None = None, af: str | None = None, max_af_gap: float = 0.30, keys: list[str] = KEYS) -> DataFrame:
    """df with group_no: neighbours belong together if the gap is at most max_dist, the columns `same` agree and,
    with `af`, the frequencies differ by at most max_af_gap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.lag("end").over(w).isNull() | (F.col("beg") - F.lag("end").over(w) > max_dist)
    for s in same or []:
        new = new | ~F.col(s).eqNullSafe(F.lag(s).over(w))
    if af:
        new = new | (F.abs(F.col(af) - F.lag(af).over(w)) > max_af_gap)
    return islands(df, keys, order, new, "group_no")


def merge_groups(grouped: DataFrame, keys: list[str] = KEYS, kind: str = "sv_class") -> DataFrame:
    return grouped.groupBy(*keys, "group_no").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.min(kind).alias(kind), F.count("*").alias("n_sv"))


def telomeric_deletion(df: DataFrame, arm: str, length: str = "ref_len", max_dist: int = 500_000, keys: list[str] = KEYS, kind: str = "sv_class", tie: str = "event_id") -> DataFrame:
    """(keys, event) of the first SV (arm p) or the last (arm q), if it is a deletion within max_dist of the end."""
    cols = [c for c in df.columns if c not in keys]
    rank = F.struct("beg", tie) if arm == "p" else F.struct("end", tie)
    pick = F.min_by(F.struct(*cols), rank) if arm == "p" else F.max_by(F.struct(*cols), rank)
    near = F.col("beg") <= max_dist if arm == "p" else F.col(length) - F.col("end") <= max_dist
    return df.groupBy(*keys).agg(pick.alias("__m")).select(*keys, "__m.*").where(F.col(kind).startswith("del") & near)


def adjacent_duplications(df: DataFrame, arm: str, max_dist: int = 7_000_000, keys: list[str] = KEYS, kind: str = "sv_class", tie: str = "event_id") -> DataFrame:
    """(keys, n_run, n_dup): the run of duplication-like SVs that follows the outermost SV of an arm without a gap
    beyond max_dist; kept if it holds a plain or inverted duplication."""
    if arm == "p":
        w = Window.partitionBy(*keys).orderBy("beg", tie)
        gap = F.col("beg") - F.lag("end").over(w)
    else:
        w = Window.partitionBy(*keys).orderBy(F.desc("end"), F.desc(tie))
        gap = F.lag("beg").over(w) - F.col("end")
    rows = df.withColumn("__at", F.row_number().over(w)).withColumn("__ok", F.col(kind).rlike("^(complex|dup|idup)") & (gap <= max_dist))
    run = F.min(F.when(F.col("__at") == 1, True).otherwise(F.col("__ok"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    taken = rows.withColumn("__run", run).where("__run and __at > 1")
    return taken.groupBy(*keys).agg(F.count("*").alias("n_run"), F.count_if(F.col(kind).rlike("^i?dup")).alias("n_dup")).where("n_dup > 0")


def breakage_fusion_bridge(df: DataFrame, arm: str, keys: list[str] = KEYS, **kw) -> DataFrame:
    """Keys with both a terminal deletion and adjacent duplications on the arm."""
    return telomeric_deletion(df, arm, keys=keys, **kw).select(*keys).join(adjacent_duplications(df, arm, keys=keys), keys)


def consensus_segments(df: DataFrame, kind: str = "sv_class", af: str = "af") -> DataFrame:
    """Per distinct (ref, beg, end): cells, mean frequency and most frequent class (least of equals)."""
    n = df.groupBy("ref", "beg", "end", kind).agg(F.count("*").alias("__n"), F.sum(af).alias("__af"))
    return n.groupBy("ref", "beg", "end").agg(F.sum("__n").alias("n_cells"), (F.sum("__af") / F.sum("__n")).alias("mean_af"), F.min_by(kind, F.struct(-F.col("__n"), F.col(kind))).alias(kind))


def haplotype_bias(df: DataFrame, haplo: str = "haplotype", keys: list[str] = KEYS) -> DataFrame:
    """(keys, h1, h2, p): Fisher's test of the two haplotypes' counts against an even split."""
    n = df.groupBy(*keys).agg(F.count_if(F.col(haplo) == "h1").alias("h1"), F.count_if(F.col(haplo) == "h2").alias("h2"))

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fisher_exact(int(x), int(y), (x + y) // 2, (x + y) - (x + y) // 2) for x, y in zip(a, b)])

    return n.withColumn("p", p("h1", "h2"))


def spacing_test(df: DataFrame, least: int, draws: int, length: str = "ref_len", keys: list[str] = KEYS, seed: int = 7) -> DataFrame:
    """(keys, n_sv, p, score): two-sample KS of the gaps between SVs against those of random placements on the
    chromosome; score -log2 of the ratio of medians. Below `least` SVs p is 1. The seed depends on the key alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["beg", "end"], kind="stable")
        n = len(pdf)
        first = pdf.iloc[0]
        out = {k: [first[k]] for k in keys} | {"n_sv": [n], "p": [1.0], "score": [0.0]}
        if n >= max(2, least):
            gaps = (pdf["beg"].to_numpy()[1:] - pdf["end"].to_numpy()[:-1]).astype(float)
            rng = np.random.default_rng([seed, *[zlib.crc32(str(first[k]).encode()) for k in keys]])
            size = (pdf["end"] - pdf["beg"]).to_numpy().astype(float)
            free = max(1.0, float(first[length]) - size.sum())
            rand = np.concatenate([np.diff(np.sort(rng.uniform(0, free, n))) for _ in range(draws)])
            m, r = float(np.median(gaps)), float(np.median(rand))
            out["p"] = [ks_two_sample(gaps, rand)[1]]
            out["score"] = [float(-np.log2(m / r)) if m > 0 and r > 0 else 0.0]
        return pd.DataFrame(out)

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n_sv bigint, p double, score double"
    return df.select(*keys, "beg", "end", length).groupBy(*keys).applyInPandas(run, schema)


def enrichment(counts: DataFrame, contigs: DataFrame, cell: str = "cell_id", pseudo: float = 1.0) -> DataFrame:
    """(cell, ref, n_sv, expected, density, score): SVs per chromosome against a placement in proportion to length.
    The mean and SD of that placement are binomial in closed form; `density` is the normal density at the count."""
    total = counts.groupBy(cell).agg(F.sum("n_sv").alias("__all"))
    genome = contigs.agg(F.sum("ref_len")).first()[0] or 1
    rows = counts.join(total, cell).join(contigs.select(F.col("ref_name").alias("ref"), "ref_len"), "ref")
    share = F.col("ref_len") / F.lit(float(genome))
    rows = rows.withColumn("expected", F.col("__all") * share).withColumn("__sd", F.sqrt(F.col("__all") * share * (1 - share)))

    @F.pandas_udf("double")
    def density(n: pd.Series, mean: pd.Series, sd: pd.Series) -> pd.Series:
        return pd.Series([normal_density(*x) for x in zip(n, mean, sd)])

    score = F.log2((F.col("n_sv") + pseudo) / F.col("expected") + pseudo)
    return rows.select(cell, "ref", "n_sv", "expected", density(F.col("n_sv").cast("double"), "expected", "__sd").alias("density"), score.alias("score"))


def chromothriptic(enriched: Column, clustered: Column, biased: Column) -> Column:
    return enriched & clustered & biased


def call_parts(name: Column) -> Column:
    """`type_haplotype` -> struct(sv_class, haplotype); the latter null if absent."""
    p = F.split(name, "_")
    return F.struct(F.get(p, F.lit(0)).alias("sv_class"), F.get(p, F.lit(1)).alias("haplotype"))


def dense_windows(df: DataFrame, size: int = 10_000_000, least: int = 3, reach: float = 1.0, core: int = 2, max_median: float = 0.0, min_sv: int = 4, keys: list[str] = KEYS, tie: str = "event_id") -> DataFrame:
    """(keys, window, n_sv, median_distance, label): windows of at least `least` SVs, density-clustered per key by
    their count and median gap in units of the window's width; kept are those of a cluster with many, close SVs."""
    from .clustering import density_labels
    from .grouped import label_groups

    hit = df.withColumn("window", F.explode(F.expr(f"sequence(beg div {size}, end div {size})")))
    by = [*keys, "window"]
    w = median_distance(hit, ["beg", tie], by).where(F.col("n_sv") >= least)
    w = w.withColumn("__d", F.coalesce(F.col("median_distance"), F.lit(0.0)) / size)
    got = label_groups(w, keys, ["window"], ["n_sv", "__d"], lambda n, d: (density_labels(np.column_stack([n.astype(float), d]), reach, core),), ["label"])
    return got.where((F.col("label") >= 0) & (F.col("median_distance") <= max_median) & (F.col("n_sv") >= min_sv)).drop("__d")
