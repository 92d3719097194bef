"""Bridges and junctions between break-end clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import begin_join, range_join


def coord(ref: Column, pos: Column) -> Column:
    return F.concat(ref, F.lit(":"), pos.cast("string"))


def junction_coord(ref_a: Column, pos_a: Column, ref_b: Column, pos_b: Column, reverse: bool = False) -> Column:
    a, b = coord(ref_a, pos_a), coord(ref_b, pos_b)
    return F.concat_ws("-", b, a) if reverse else F.concat_ws("-", a, b)


def junction_type(ref_a: Column, ref_b: Column) -> Column:
    return F.when(ref_a == ref_b, "intrachromosomal").otherwise("interchromosomal")


def junctions(partners: DataFrame, clusters: DataFrame, min_reads: int, min_pct: float, buffer: int = 100) -> DataFrame:
    """(meta_a, meta_b, n_reads, pct, type): supplementary partners (meta, ref, beg, end, n_reads, pct, m_ref, m_pos)
    that overlap another break-end cluster (r_meta, r_ref, r_beg, r_end) within buffer, each pair of clusters once
    whichever side saw it, with the stronger support."""
    ok = partners.where((F.col("n_reads") >= min_reads) & (F.col("pct") >= min_pct))
    pairs = range_join(ok, clusters, buffer).where("meta <> r_meta")
    both = pairs.select(
        F.least("meta", "r_meta").alias("meta_a"), F.greatest("meta", "r_meta").alias("meta_b"), "n_reads", "pct", junction_type(F.col("m_ref"), F.col("r_ref")).alias("type")
    )
    return both.groupBy("meta_a", "meta_b", "type").agg(F.max("n_reads").alias("n_reads"), F.max("pct").alias("pct"))


def own_junctions(clusters: DataFrame, min_reads: int, min_pct: float, buffer: int = 100) -> DataFrame:
    """`junctions` of clusters (meta, ref, beg, end, n_reads, pct; meta is unique) that are each their own partner, at
    their own place. Two of them see each other or neither does, so a pair is met once, from the side that begins
    first (then by meta), and is a row of the result at once: nothing moves or gathers the pairs."""
    ok = (F.col("n_reads") >= min_reads) & (F.col("pct") >= min_pct)
    c = clusters.select("meta", "ref", "beg", "end", F.coalesce(ok, F.lit(False)).alias("ok"), F.when(ok, F.col("n_reads")).alias("n_reads"), F.when(ok, F.col("pct")).alias("pct"))
    later = c.select(*[F.col(x).alias(f"r_{x}") for x in c.columns])
    pairs = begin_join(c, later, buffer).where("(ok or r_ok) and (r_beg > beg or r_meta > meta) and meta <> r_meta")
    return pairs.select(
        F.least("meta", "r_meta").alias("meta_a"), F.greatest("meta", "r_meta").alias("meta_b"), F.lit("intrachromosomal").alias("type"),
        F.greatest("n_reads", "r_n_reads").alias("n_reads"), F.greatest("pct", "r_pct").alias("pct"),
    )


def union_support(members: DataFrame, edges: DataFrame, meta: str = "meta", read: str = "read_name", role: str = "role") -> DataFrame:
    """Distinct reads of either side of each junction (meta_a, meta_b), in all and by role."""
    sides = edges.select("meta_a", "meta_b", F.explode(F.array("meta_a", "meta_b")).alias("__m"))
    reads = sides.join(members.select(F.col(meta).alias("__m"), read, role), "__m").groupBy("meta_a", "meta_b", read).agg(F.min(role).alias("__r"), F.count_distinct("__m").alias("__sides"))
    return reads.groupBy("meta_a", "meta_b").agg(
        F.count("*").alias("n_reads"), F.count_if(F.col("__r") == "TUMOUR").alias("n_tumour"), F.count_if(F.col("__r") == "NORMAL").alias("n_normal"), F.count_if(F.col("__sides") == 2).alias("n_spanning")
    )


def chimeric_pairs(a: DataFrame, b: DataFrame, read: str = "read_name") -> DataFrame:
    """Clippings of two clusters that belong to one read, one of them primary, one supplementary: per read the pair
    with the longest reference span, with same_strand."""
    left = a.select(read, F.col("event_id").alias("id_a"), F.col("supplementary").alias("s_a"), F.col("is_reverse").alias("rev_a"), F.col("ref_span").alias("span_a"))
    right = b.select(read, F.col("event_id").alias("id_b"), F.col("supplementary").alias("s_b"), F.col("is_reverse").alias("rev_b"), F.col("ref_span").alias("span_b"))
    pairs = left.join(right, read).where("s_a <> s_b").withColumn("same_strand", F.expr("rev_a = rev_b"))
    return pairs.groupBy(read).agg(F.max_by(F.struct("id_a", "id_b", "same_strand"), F.struct(F.expr("span_a + span_b"), -F.col("id_a"))).alias("m")).select(read, "m.*")


def bridge(support: DataFrame, meta: str, min_reads: int, min_pct: float, total: str) -> DataFrame:
    """(meta, bridge_type, n_reads, types): from supplementary clusters that support a bridge (meta, read_name,
    support_type, bridge_type): the type if all agree, else `unknown`, where reads and share suffice."""
    g = support.groupBy(meta).agg(
        F.count_distinct("read_name").alias("n_reads"), F.array_sort(F.collect_set("support_type")).alias("types"), F.min("bridge_type").alias("__lo"), F.max("bridge_type").alias("__hi"), F.max(total).alias("__n")
    )
    ok = (F.col("n_reads") >= min_reads) & (F.col("n_reads") * 100 >= min_pct * F.col("__n"))
    return g.where(ok).select(meta, F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise("unknown").alias("bridge_type"), "n_reads", "types")


def breakpoints_agree(a1: Column, b1: Column, a2: Column, b2: Column, most: int = 1500) -> Column:
    """Two breakpoint pairs, in either order, agree within `most` bases."""
    return (F.abs(F.least(a1, b1) - F.least(a2, b2)) <= most) & (F.abs(F.greatest(a1, b1) - F.greatest(a2, b2)) <= most)


def aligned_bridges(clusters: DataFrame, transduced: DataFrame, repeats: DataFrame, key: str, max_len: int = 10_000, min_pct: float = 50.0) -> DataFrame:
    """(key, bridge_type, label, pct): supplementary clusters (key, ref, beg, end) of at most max_len that share more
    than min_pct per cent of themselves with a repeat (`solo`) or, failing that, with a transduced region
    (`transduced`); the largest share decides, then the lesser label. Both tables have r_ref, r_beg, r_end, label."""
    from .intervals import overlap_span

    kinds = [f.where("label is not null").select("r_ref", "r_beg", "r_end", "label", F.lit(i).alias("__kind")) for i, f in enumerate((repeats, transduced))]
    short = clusters.select(key, "ref", "beg", "end").where((F.col("end") > F.col("beg")) & (F.col("end") - F.col("beg") <= max_len))
    pairs = range_join(short, kinds[0].unionByName(kinds[1]))
    pct = overlap_span("beg", "end", "r_beg", "r_end")["bp"] * F.lit(100.0) / (F.col("end") - F.col("beg"))
    hit = pairs.withColumn("pct", pct).where(F.col("pct") > min_pct)
    best = hit.groupBy(key).agg(F.min_by(F.struct("__kind", "label", "pct"), F.struct(F.col("__kind"), -F.col("pct"), F.col("label"))).alias("m"))
    return best.select(key, F.when(F.col("m.__kind") == 0, "solo").otherwise("transduced").alias("bridge_type"), "m.label", "m.pct")


def search_bridge(support: DataFrame, meta: str, total: str, min_reads: int, min_pct: float) -> DataFrame:
    """(meta, bridge_type, n_reads, pct, support_types) of break-end clusters with a bridge.

    support: (meta, cluster_id, read_name, support_type of `aligned` or `unaligned`, bridge_type, total reads of the
    metacluster). The unaligned cluster with most reads (least id of equals) is taken, with the aligned ones of its
    type; without one all aligned ones, the type being `unknown` where they differ. A bridge needs min_reads distinct
    reads and min_pct per cent of the metacluster's."""
    per = support.groupBy(meta, "cluster_id", "support_type", "bridge_type").agg(F.count_distinct("read_name").alias("__n"))
    free = per.where("support_type = 'unaligned'").groupBy(meta).agg(F.min_by(F.struct("cluster_id", "bridge_type"), F.struct(-F.col("__n"), F.col("cluster_id"))).alias("__free"))
    rows = support.join(free, meta, "left")
    chosen = F.when(F.col("__free").isNull(), F.lit(True)).otherwise(
        F.when(F.col("support_type") == "unaligned", F.col("cluster_id") == F.col("__free.cluster_id")).otherwise(F.col("bridge_type").eqNullSafe(F.col("__free.bridge_type")))
    )
    g = rows.where(chosen).groupBy(meta).agg(
        F.count_distinct("read_name").alias("n_reads"), F.array_sort(F.collect_set("support_type")).alias("support_types"), F.min("bridge_type").alias("__lo"), F.max("bridge_type").alias("__hi"), F.max(total).alias("__all")
    )
    pct = F.coalesce(F.try_divide(F.col("n_reads") * F.lit(100.0), F.col("__all")), F.lit(0.0))
    g = g.withColumn("pct", pct).where((F.col("n_reads") >= min_reads) & (F.col("pct") >= min_pct))
    return g.select(meta, F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise("unknown").alias("bridge_type"), "n_reads", "pct", "support_types")


def template_reads(members: DataFrame, edges: DataFrame, meta: str = "meta", read: str = "read_name", n_sa: str = "n_sa") -> DataFrame:
    """(meta_a, meta_b, read_name, sides, n_sa, place): the reads of each junction in the order in which they serve as
    template of its consensus: those in both clusters first, then the fewest supplementary alignments, then by name."""
    sides = edges.select("meta_a", "meta_b", F.explode(F.array("meta_a", "meta_b")).alias("__m"))
    reads = sides.join(members.where(F.col(read).isNotNull()).select(F.col(meta).alias("__m"), read, n_sa), "__m").groupBy("meta_a", "meta_b", read).agg(F.count_distinct("__m").alias("sides"), F.min(n_sa).alias(n_sa))
    order = Window.partitionBy("meta_a", "meta_b").orderBy(F.desc("sides"), n_sa, read)
    return reads.withColumn("place", F.row_number().over(order).cast("bigint"))


def consensus_agrees(hits: DataFrame, key: str, most: int = 1500) -> DataFrame:
    """(key, agrees): whether the breakpoints that a junction's consensus shows, the facing ends of its outermost hits
    (key, q_beg, t_beg, t_end, strand, bkp_a, bkp_b), lie within `most` of those of the junction."""
    edge = lambda last: F.when((F.col("strand") == "+") != F.lit(last), F.col("t_end")).otherwise(F.col("t_beg"))
    g = hits.groupBy(key).agg(
        F.min_by(edge(False), F.struct("q_beg", "t_beg")).alias("x"), F.max_by(edge(True), F.struct("q_beg", "t_beg")).alias("y"), F.count("*").alias("__n"), F.max("bkp_a").alias("a"), F.max("bkp_b").alias("b")
    )
    near = F.coalesce(breakpoints_agree(F.col("x"), F.col("y"), F.col("a"), F.col("b"), most), F.lit(False))
    return g.select(key, ((F.col("__n") >= 2) & near).alias("agrees"))
