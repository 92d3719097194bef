"""Genomic intervals: overlap measures as column expressions, fixed bins, the bin hierarchy and the range join.

Two conventions live side by side and keep separate names: `overlaps`/`overlap_bp` count both ends (closed
intervals, length + 1), `overlap_span` gives the shared coordinates without the extra base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of the reference's bin index; the last level holds whatever fits no other.
BIN_LEVELS = (10_000, 100_000, 1_000_000)
#: Finest cell of a range join and the factor between its levels.
CELL, FACTOR, TOP = 1024, 8, 8
#: Finest cell of a join of begins, where every interval meets points.
FINE = 64


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def overlaps(beg_a, end_a, beg_b, end_b) -> Column:
    """Closed intervals share at least one position."""
    return (c(beg_a) <= c(end_b)) & (c(beg_b) <= c(end_a))


def overlap_bp(beg_a, end_a, beg_b, end_b) -> Column:
    """Shared positions of closed intervals; 0 if they share none."""
    n = F.least(c(end_a), c(end_b)) - F.greatest(c(beg_a), c(beg_b)) + 1
    return F.greatest(n, F.lit(0))


def overlap_span(beg_a, end_a, beg_b, end_b) -> Column:
    """struct(beg, end, bp) of the shared stretch, null without one; touching intervals share 0 bp."""
    lo, hi = F.greatest(c(beg_a), c(beg_b)), F.least(c(end_a), c(end_b))
    return F.when(overlaps(beg_a, end_a, beg_b, end_b), F.struct(lo.alias("beg"), hi.alias("end"), (hi - lo).alias("bp")))


def reciprocal_pct(beg_a, end_a, beg_b, end_b) -> Column:
    """struct(pct_a, pct_b): shared positions over end - beg; 0 for an interval of no length."""
    n = overlap_bp(beg_a, end_a, beg_b, end_b)
    pct = lambda b, e: F.when(c(e) > c(b), n / (c(e) - c(b)) * 100).otherwise(F.lit(0.0))
    return F.struct(pct(beg_a, end_a).alias("pct_a"), pct(beg_b, end_b).alias("pct_b"))


def reciprocal(beg_a, end_a, beg_b, end_b, min_pct: float) -> Column:
    p = reciprocal_pct(beg_a, end_a, beg_b, end_b)
    return overlaps(beg_a, end_a, beg_b, end_b) & (p["pct_a"] >= min_pct) & (p["pct_b"] >= min_pct)


def complementary(beg_a, end_a, beg_b, end_b, max_dist: float, max_pct: float) -> Column:
    """struct(ok, side, bp): near (both extended by max_dist they overlap) but sharing at most max_pct of either;
    side is LEFT if b lies to the left of a, else RIGHT; both null unless ok."""
    n = overlap_bp(beg_a, end_a, beg_b, end_b)
    near = overlaps(c(beg_a) - max_dist, c(end_a) + max_dist, c(beg_b) - max_dist, c(end_b) + max_dist)
    pct = lambda b, e: n / (c(e) - c(b) + 1) * 100
    ok = near & (pct(beg_a, end_a) <= max_pct) & (pct(beg_b, end_b) <= max_pct)
    side = F.when(c(beg_a) > c(beg_b), "LEFT").otherwise("RIGHT")
    return F.struct(ok.alias("ok"), F.when(ok, side).alias("side"), F.when(ok, n).alias("bp"))


def genomic_bins(contigs: DataFrame, size: int, ref: str = "ref_name", length: str = "ref_len", refs: list[str] | None = None) -> DataFrame:
    """(ref, beg, end) of the fixed bins [k * size, min((k + 1) * size, length)) of each contig."""
    rows = contigs.where(c(ref).isin(refs)) if refs else contigs
    starts = F.explode(F.expr(f"sequence(cast(0 as bigint), {length} - 1, cast({size} as bigint))"))
    return rows.where(c(length) > 0).select(c(ref).alias("ref"), c(length).alias("__len"), starts.alias("beg")).select(
        "ref", "beg", F.least(c("beg") + size, c("__len")).alias("end")
    )


def bin_of(pos, size: int) -> Column:
    """Bin index, truncating toward zero as integer division does."""
    return F.expr(f"cast({pos} as bigint) div {size}") if isinstance(pos, str) else F.floor(pos / size)


def bin_level(beg: str, end: str, levels: tuple[int, ...] = BIN_LEVELS, strict: bool = False) -> Column:
    """The smallest level at which both ends fall into one bin; -1 (the root) if there is none, or null with
    strict=True, where such items are lost."""
    out = F.lit(None).cast("bigint") if strict else F.lit(-1).cast("bigint")
    for size in reversed(levels):
        out = F.when(F.expr(f"{beg} div {size} = {end} div {size}"), F.lit(size).cast("bigint")).otherwise(out)
    return out


def _level(beg: str, end: str, cell: int = CELL) -> str:
    """Smallest level of the range join at which [beg, end] spans at most FACTOR + 1 cells."""
    out = str(TOP)
    for lv in range(TOP - 1, -1, -1):
        out = f"if({end} - {beg} < {cell * FACTOR ** (lv + 1)}, {lv}, {out})"
    return f"cast({out} as int)"


def _placed(df: DataFrame, beg: str, end: str, tag: str, other: list[int]) -> DataFrame:
    """One row per cell: at the interval's own level, and at each coarser level that the other side uses."""
    own = f"__lv{tag}"
    df = df.withColumn(own, F.expr(_level(beg, end)))
    more = F.array(*[F.lit(x) for x in sorted(other)]) if other else F.expr("cast(array() as array<int>)")
    levels = F.concat(F.array(F.col(own)), F.filter(more, lambda x: x > F.col(own)))
    df = df.withColumn("__level", F.explode(levels))
    width = f"(cast({CELL} as bigint) * cast(pow({FACTOR}, __level) as bigint))"
    cells = f"sequence(cast(floor({beg} / {width}) as bigint), cast(floor({end} / {width}) as bigint))"
    return df.withColumn("__cell", F.explode(F.expr(cells)))


def _used_levels(a: DataFrame, b: DataFrame) -> tuple[list[int], list[int]]:
    """Levels that the intervals of either side have: one job over both, which reads their bounds alone."""
    both = a.select(F.lit(0).alias("side"), F.expr(_level("__ab", "__ae")).alias("lv")).unionByName(b.select(F.lit(1).alias("side"), F.expr(_level("r_beg", "r_end")).alias("lv")))
    bits = both.agg(*[F.bit_or(F.when(F.col("side") == s, F.expr("shiftleft(1, lv)"))) for s in (0, 1)]).first()
    return tuple([lv for lv in range(TOP + 1) if (m or 0) >> lv & 1] for m in bits)


def range_join(left: DataFrame, right: DataFrame, buffer: int = 0, equal: list[tuple[str, str]] | None = None) -> DataFrame:
    """All pairs of closed intervals that overlap on the same ref, each once.

    `left` has ref, beg, end and `right` has r_ref, r_beg, r_end, next to columns of their own; names must differ
    between the sides. `buffer` widens the left intervals on both sides for the test only; `equal` adds equality
    conditions (left column, right column). Rows with a null ref or bound, or end < beg, pair with nothing.

    Both sides are read twice, once for the levels of their intervals: settle what is costly to make.
    Intervals are laid out in a hierarchy of cells, each FACTOR times as wide as those below. An interval covers
    at most FACTOR + 1 cells of its own level; a pair meets at the coarser of its two levels, in the cell of the
    later begin. This is an equi-join whatever the mix of lengths, and AQE splits its skewed cells.
    """
    a = left.where("ref is not null and beg is not null and end >= beg").withColumn("__ab", F.col("beg") - buffer).withColumn("__ae", F.col("end") + buffer)
    b = right.where("r_ref is not null and r_beg is not null and r_end >= r_beg")
    la, lb = _used_levels(a, b)
    pa = _placed(a, "__ab", "__ae", "a", lb)
    pb = _placed(b, "r_beg", "r_end", "b", la).withColumnRenamed("__level", "__level_b").withColumnRenamed("__cell", "__cell_b")
    width = f"(cast({CELL} as bigint) * cast(pow({FACTOR}, __level) as bigint))"
    on = (
        (F.col("ref") == F.col("r_ref"))
        & (F.col("__level") == F.col("__level_b"))
        & (F.col("__cell") == F.col("__cell_b"))
        & (F.col("__level") == F.greatest("__lva", "__lvb"))
        & overlaps("__ab", "__ae", "r_beg", "r_end")
        & (F.col("__cell") == F.expr(f"cast(floor(greatest(__ab, r_beg) / {width}) as bigint)"))
    )
    for x, y in equal or []:
        on = on & (F.col(x) == F.col(y))
    return pa.join(pb, on).drop("__ab", "__ae", "__lva", "__lvb", "__level", "__cell", "__level_b", "__cell_b")


def begin_join(left: DataFrame, right: DataFrame, buffer: int = 0) -> DataFrame:
    """All pairs on the same ref in which the begin of the right interval lies in [beg, end + buffer] of the left one,
    each once. Columns and rows without a place as in `range_join`.

    A begin is a point, so it has one cell at each level that left intervals have; a pair meets in it at the level of
    the left interval. Cells are no wider than that interval (FINE at least), so few candidates are looked at in vain.
    """
    a = left.where("ref is not null and beg is not null and end >= beg").withColumn("__ae", F.col("end") + buffer).where("__ae >= beg")
    b = right.where("r_ref is not null and r_beg is not null and r_end >= r_beg")
    a = a.withColumn("__level", F.expr(_level("beg", "__ae", FINE)))
    bits = a.agg(F.bit_or(F.expr("shiftleft(1, __level)"))).first()[0] or 0
    used = [lv for lv in range(TOP + 1) if bits >> lv & 1]
    width = f"(cast({FINE} as bigint) * cast(pow({FACTOR}, __level) as bigint))"
    pa = a.withColumn("__cell", F.explode(F.expr(f"sequence(cast(floor(beg / {width}) as bigint), cast(floor(__ae / {width}) as bigint))")))
    pb = b.withColumn("__level", F.explode(F.array(*[F.lit(lv) for lv in used]) if used else F.expr("cast(array() as array<int>)")))
    pb = pb.withColumn("__cell", F.expr(f"cast(floor(r_beg / {width}) as bigint)")).withColumnRenamed("__level", "__level_b").withColumnRenamed("__cell", "__cell_b")
    on = (F.col("ref") == F.col("r_ref")) & (F.col("__level") == F.col("__level_b")) & (F.col("__cell") == F.col("__cell_b")) & F.col("r_beg").between(F.col("beg"), F.col("__ae"))
    return pa.join(pb, on).drop("__ae", "__level", "__cell", "__level_b", "__cell_b")


def range_anti(left: DataFrame, right: DataFrame, key: str, buffer: int = 0) -> DataFrame:
    """Rows of `left` whose interval, widened by buffer, overlaps none of `right`; `key` identifies a left row."""
    hit = range_join(left.select(key, "ref", "beg", "end"), right.select("r_ref", "r_beg", "r_end"), buffer).select(F.col(key)).distinct()
    return left.join(hit, key, "left_anti")


def range_top1(left: DataFrame, right: DataFrame, key: str, buffer: int = 0, ties: list[str] | None = None) -> DataFrame:
    """For each left row its partner of the largest overlap (bp; ties: lower begin, then `ties`)."""
    pairs = range_join(left, right, buffer).withColumn("overlap_bp", overlap_bp("beg", "end", "r_beg", "r_end"))
    rest = [x for x in pairs.columns if x != key]
    order = F.struct(-F.col("overlap_bp"), F.col("r_beg"), *[F.col(t) for t in ties or []])
    best = pairs.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("__m"))
    return best.select(key, *[F.col(f"__m.{x}").alias(x) for x in rest])


def complement(df: DataFrame, keys: list[str], length: str, beg: str = "beg", end: str = "end") -> DataFrame:
    """(keys, beg, end) not covered by any interval within [0, length], one row per hole of positive length.
    `length` is a column that is constant per key. The holes between intervals are the gaps of `periods_and_gaps`."""
    from .periods import periods_and_gaps

    df = df.where(F.col(end) > F.col(beg))
    inner = periods_and_gaps(df, keys, beg, end).where("kind = 'gap'").select(*keys, "beg", F.col("end_pos").alias("end"))
    hull = df.groupBy(*keys).agg(F.min(beg).alias("__lo"), F.max(end).alias("__hi"), F.max(length).alias("__len"))
    edges = F.array(F.struct(F.lit(0).cast("bigint").alias("b"), F.col("__lo").cast("bigint").alias("e")), F.struct(F.col("__hi").cast("bigint").alias("b"), F.col("__len").cast("bigint").alias("e")))
    outer = hull.select(*keys, F.explode(edges).alias("x")).where("x.e > x.b").select(*keys, F.col("x.b").alias("beg"), F.col("x.e").alias("end"))
    return inner.unionByName(outer)
