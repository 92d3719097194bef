"""Queries over the named filter sets: every filter of a kind of cluster, with the list of those that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..conf import EngineConf
from ..operators import aggregates as ag
from ..operators import annotation as an
from ..operators import clustering as cl
from ..operators import filters as fl
from ..session import settle
from . import tables as tb
from .reference import _CHAIN, query
from .tables import AN_SQL

_CLIP_CHAIN = _CHAIN.replace("sv_type = 'INS'", "sv_type = 'CLIPPING'")
_ROLES = """count(DISTINCT read_name) AS n_reads,
  CASE WHEN count(*) FILTER (role IS NULL) = 0 THEN count(DISTINCT coalesce(read_name, '~')) FILTER (role = 'TUMOUR') END AS n_tumour,
  CASE WHEN count(*) FILTER (role IS NULL) = 0 THEN count(DISTINCT coalesce(read_name, '~')) FILTER (role = 'NORMAL') END AS n_normal"""
_OK = "CASE WHEN n_tumour IS NOT NULL AND n_normal IS NOT NULL THEN n_tumour >= 2 OR n_normal >= 1 ELSE n_reads >= 2 END"
_TARGETS = tuple(f"ctg{i:02d}" for i in range(1, 30)) + tuple(f"chr{i}" for i in range(1, 15))
_IN_TARGETS = "(" + ", ".join(f"'{t}'" for t in _TARGETS) + ")"
_CONF = EngineConf(target_refs=_TARGETS, max_reads=20)


def _clusters(spark, sf, kind):
    """(members, statistics per cluster) of one event type; the id is a text of ref and number."""
    m = settle(cl.bin_chain_clusters(tb.settled_events(spark, sf, kind), "ref", "beg", "end", 1000, 200).withColumn("id", F.concat_ws(":", "ref", "cluster_no")))
    _, cv = ag.length_cv(F.col("len"))
    stats = m.groupBy("id").agg(
        F.first("ref").alias("ref"), F.min("beg").alias("beg"), F.max("end").alias("end"), F.count("*").alias("n_events"), F.count_if("is_dup").alias("n_dup"), F.count_if(F.col("role") == "NORMAL").alias("n_normal_events"),
        F.avg("mapq").alias("mapq"), F.min("len").alias("shortest"), F.count_distinct(F.col("beg") % 1000).alias("n_coords"), cv.alias("cv"), F.max("sample_name").alias("identity"),
        F.avg((F.col("mapq") <= 20).cast("int")).alias("share_low_mapq"), F.avg(F.col("is_dup").cast("int")).alias("share_clipped"), ag.unanimous(F.expr("if(is_reverse, 'MINUS', 'PLUS')"), "PLUS", "MINUS", "RECIPROCAL").alias("orientation"),
        *[F.struct(F.min(F.when(F.col("is_reverse") == r, F.col("beg"))).alias("beg"), F.max(F.when(F.col("is_reverse") == r, F.col("end"))).alias("end")).alias(n) for n, r in (("plus", False), ("minus", True))],
    )
    return m, stats.join(ag.support(m, ["id"]), "id")


_SIDE = f"""x AS (SELECT ref || ':' || cluster_no AS id, any_value(ref) AS ref, min(beg) AS beg, max(end_pos) AS end_pos, count(*) AS n_events, count(*) FILTER (is_dup) AS n_dup, count(*) FILTER (role = 'NORMAL') AS n_normal_events,
  avg(mapq) AS mapq, min(len) AS shortest, count(DISTINCT beg % 1000) AS n_coords, {_ROLES} FROM mem GROUP BY 1),
hit AS (SELECT DISTINCT id FROM x JOIN an ON ref = r_ref AND beg + 50000 - 10000 <= r_end AND r_beg <= end_pos + 50100 + 10000 WHERE feat_family = 'SVA'),
y AS (SELECT x.*, hit.id IS NOT NULL AS near FROM x LEFT JOIN hit ON x.id = hit.id)"""


@query(f"""WITH {_CLIP_CHAIN}, {AN_SQL}, {_SIDE}
SELECT id, concat_ws(',', CASE WHEN NOT {_OK} THEN 'MIN-NBREADS' END, CASE WHEN ref NOT IN {_IN_TARGETS} THEN 'SUPPL-REF' END, CASE WHEN near THEN 'SUPPL-SRC' END, CASE WHEN NOT coalesce(mapq >= 10, false) THEN 'SUPPL-MAPQ' END,
  CASE WHEN n_normal_events >= 1 THEN 'GERMLINE' END, CASE WHEN n_dup * 100.0 / n_events >= 75 THEN 'READ-DUP' END, CASE WHEN n_events > 1 AND n_coords <= 2 THEN 'CLUSTER-RANGE' END) AS failed FROM y""")
def q97_clipping_filters(spark, sf):
    """All seven, the supplementary clusters lying 50 kb downstream on the same contig."""
    _, k = _clusters(spark, sf, "CLIPPING")
    k = k.withColumn("suppl_ref", F.col("ref")).withColumn("suppl_beg", F.col("beg") + 50_000).withColumn("suppl_end", F.col("end") + 50_100).withColumn("suppl_mapq", F.col("mapq"))
    got = fl.judge_clippings(settle(k), "id", _CONF, sources=tb.features(spark, sf).where("feat_family = 'SVA'"))
    return got.select("id", F.array_join("failed_filters", ",").alias("failed"))


@query(f"""WITH {_CLIP_CHAIN}, {AN_SQL}, {_SIDE}
SELECT id, concat_ws(',', CASE WHEN NOT {_OK} THEN 'MIN-NBREADS' END, CASE WHEN ref NOT IN {_IN_TARGETS} THEN 'MATE-REF' END, CASE WHEN near THEN 'MATE-SRC' END, CASE WHEN NOT coalesce(mapq >= 10, false) THEN 'MATE-MAPQ' END,
  CASE WHEN n_normal_events >= 1 THEN 'GERMLINE' END, CASE WHEN n_events / nullif(n_reads, 0)::DOUBLE <= 0.95 THEN 'UNSPECIFIC' END, CASE WHEN n_dup * 100.0 / n_events >= 75 THEN 'READ-DUP' END,
  CASE WHEN n_events > 1 AND end_pos - beg <= shortest THEN 'CLUSTER-RANGE' END) AS failed FROM y""")
def q98_discordant_filters(spark, sf):
    """All eight, on the same clusters taken as discordant ones."""
    _, k = _clusters(spark, sf, "CLIPPING")
    k = k.withColumn("mate_ref", F.col("ref")).withColumn("mate_beg", F.col("beg") + 50_000).withColumn("mate_end", F.col("end") + 50_100).withColumn("mate_mapq", F.col("mapq"))
    k = k.withColumn("specificity", F.try_divide(F.col("n_events").cast("double"), F.col("n_reads")))
    got = fl.judge_discordants(settle(k), "id", _CONF, sources=tb.features(spark, sf).where("feat_family = 'SVA'"))
    return got.select("id", F.array_join("failed_filters", ",").alias("failed"))


@query(f"""WITH {_CHAIN}, {AN_SQL}, x AS (SELECT ref || ':' || cluster_no AS id, any_value(ref) AS ref, min(beg) AS beg, max(end_pos) AS end_pos, count(*) AS n, count(*) FILTER (role = 'NORMAL') AS nn, stddev_pop(len) * 100 / nullif(avg(len), 0) AS cv,
  max(sample_name) AS identity, avg(CASE WHEN mapq <= 20 THEN 1 WHEN mapq > 20 THEN 0 END) AS low, avg(CASE WHEN is_dup THEN 1 WHEN NOT is_dup THEN 0 END) AS clipped, count(*) FILTER (is_reverse) > 0 AND count(*) FILTER (NOT is_reverse) > 0 AS both_sides,
  least(max(end_pos) FILTER (is_reverse), max(end_pos) FILTER (NOT is_reverse)) - greatest(min(beg) FILTER (is_reverse), min(beg) FILTER (NOT is_reverse)) + 1 AS shared, {_ROLES} FROM mem GROUP BY 1),
hit AS (SELECT DISTINCT id FROM x JOIN an ON ref = r_ref AND beg <= r_end AND r_beg <= end_pos WHERE contains(feat_family, 'L1') AND row_id % 2 = 0),
y AS (SELECT x.*, hit.id IS NOT NULL AS near, n % 2 = 0 AS tail FROM x LEFT JOIN hit ON x.id = hit.id)
SELECT id, concat_ws(',', CASE WHEN NOT {_OK} THEN 'MIN-NBREADS' END, CASE WHEN n > 20 THEN 'MAX-NBREADS' END, CASE WHEN cv > 30 THEN 'CV' END, CASE WHEN n % 5 = 0 THEN 'SV-TYPE' END, CASE WHEN n * 37 % 100 < 60 THEN 'PERC-RESOLVED' END,
  CASE WHEN NOT coalesce(low < 0.3, false) THEN 'AREAMAPQ' END, CASE WHEN NOT coalesce(clipped < 0.15, false) THEN 'AREASMS' END, CASE WHEN identity IS NULL THEN 'IDENTITY' END, CASE WHEN NOT coalesce(n_normal < 1, false) THEN 'GERMLINE' END,
  CASE WHEN both_sides AND NOT coalesce(greatest(shared, 0) * 100.0 / nullif(end_pos - beg, 0) <= 40, false) THEN 'META-RANGE' END, CASE WHEN near AND NOT tail THEN 'ANNOTATION' END, CASE WHEN nn * 100.0 / n > 20 THEN 'SVs-NORMAL' END,
  CASE WHEN ref = 'chr6' AND NOT tail THEN 'srcREF-TDs-ref6' END) AS failed FROM y""")
def q99_metacluster_filters(spark, sf):
    """All thirteen on clusters of insertions; types, resolved shares, tails and source bands follow from the counts."""
    _, k = _clusters(spark, sf, "INS")
    n = F.col("n_events")
    k = k.withColumn("sv_type", F.when(n % 5 == 0, "BND").otherwise("INS")).withColumn("pct_resolved", n * 37 % 100).withColumn("poly_a", n % 2 == 0).withColumn("source_band", F.lit("6p22"))
    k = settle(k.withColumn("n_normal_reads", F.col("n_normal")).withColumn("pct_in_normal", F.col("n_normal_events") * F.lit(100.0) / n))
    repeats = tb.features(spark, sf).select("r_ref", "r_beg", "r_end", F.col("feat_family").alias("family"), F.expr("if(row_id % 2 = 0, 'L1PA3', 'L1HS')").alias("subfamily"))
    got = fl.judge_metaclusters(an.repeats_annotation(k, repeats, "id"), _CONF)
    return got.select("id", F.array_join("failed_filters", ",").alias("failed"))
