"""The two calling pipelines as plans over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..operators import aggregates as ag
from ..operators import annotation as an
from ..operators import clustering as cl
from ..operators import filters as fl
from ..operators import retro
from ..session import settle


def cluster_events(events: DataFrame, conf: EngineConf) -> DataFrame:
    """Events with cluster_id: insertions and clippings by bin-chained distance, deletions by the reciprocal sweep.
    The id is a text of the type, the ref and the number or extent, so it does not depend on partitions."""
    ins = cl.bin_chain_clusters(events.where("sv_type = 'INS'"), "ref", "beg", "end", max(conf.max_ins_dist, 1), conf.max_ins_dist, conf.min_cluster_size)
    clip = cl.bin_chain_clusters(events.where("sv_type = 'CLIPPING'"), "ref", "beg", "end", max(conf.max_bkp_dist, 1), conf.max_bkp_dist, conf.min_cluster_size)
    near = ins.unionByName(clip).withColumn("cluster_id", F.concat_ws(":", "sv_type", "ref", "cluster_no")).drop("cluster_no")
    swept = cl.reciprocal_clusters(events.where("sv_type = 'DEL'"), "ref", "beg", "end", "event_id", conf.del_pct, 0, conf.min_cluster_size)
    ids = swept.select("event_id", F.concat_ws(":", F.lit("DEL"), "ref", "cluster_beg", "cluster_end").alias("cluster_id"))
    return near.unionByName(events.where("sv_type = 'DEL'").join(ids, "event_id"))


def call_long_reads(events: DataFrame, repeats: DataFrame, conf: EngineConf = EngineConf()) -> DataFrame:
    """Metaclusters with type, support, filters and repeats around them, from events (event_id, ref, beg, end, len,
    sv_type, side, read_name, role, is_dup, mapq)."""
    members = settle(cluster_events(settle(events), conf))  # the events are read once, not per event type
    clusters = members.groupBy("cluster_id").agg(F.first("ref").alias("ref"), F.min("beg").alias("beg"), F.max("end").alias("end"))
    meta = cl.metaclusters(clusters, "cluster_id", conf.meta_pct, conf.meta_buffer)
    named = meta.select("cluster_id", F.concat_ws(":", "ref", "cluster_beg", "cluster_end").alias("meta"))
    rows = settle(members.join(named, "cluster_id"))
    kind = ag.event_kind(F.col("sv_type"), F.col("side"), F.lit("PLUS"))
    _, cv = ag.length_cv(F.when(F.col("sv_type") == "INS", F.col("len")))
    stats = rows.groupBy("meta").agg(
        F.first("ref").alias("ref"), F.min("beg").alias("beg"), F.max("end").alias("end"), F.count("*").alias("n_events"), F.count_if("is_dup").alias("n_dup"), cv.alias("cv"), F.collect_set(kind).alias("kinds"), F.avg("mapq").alias("mapq")
    )
    got = stats.join(ag.support(rows, ["meta"]), "meta").withColumn("sv_type", ag.sv_type(F.col("kinds"))).drop("kinds")
    ok, origin = fl.read_support(F.col("n_reads"), F.col("n_tumour"), F.col("n_normal"), conf.min_reads, conf.min_normal_reads)
    tests = {"MIN-NBREADS": ok, "MAX-NBREADS": F.col("n_events") <= conf.max_reads, "CV": F.coalesce(F.col("cv"), F.lit(0.0)) <= conf.max_cv, "SV-TYPE": F.col("sv_type").isin(*conf.target_sv)}
    judged = got.withColumn("origin", origin).withColumn("failed_filters", fl.failed(tests, fl.META))
    return an.repeats_annotation(judged, repeats, "meta")


def call_short_reads(discordants: DataFrame, stages: list[tuple[str, DataFrame]], conf: EngineConf = EngineConf()) -> DataFrame:
    """Mobile-element candidates from discordant pairs (event_id, ref, beg, end, orientation, mate_ref, mate_start,
    read_name, role): mates are identified by the cascade of `stages` (transductions, exons, repeats by name),
    events clustered by position, and each cluster typed by the majority identities of its two sides."""
    discordants = settle(discordants)
    mates = discordants.select("event_id", F.col("mate_ref").alias("ref"), F.col("mate_start").alias("beg"), (F.col("mate_start") + conf.read_size).alias("end"))
    known = discordants.join(an.cascade(mates, stages, "event_id"), "event_id")
    swept = cl.reciprocal_clusters(discordants, "ref", "beg", "end", "event_id", conf.meta_pct, conf.meta_buffer, conf.min_cluster_size)
    ids = swept.select("event_id", F.concat_ws(":", "ref", "cluster_beg", "cluster_end").alias("meta"))
    rows = settle(known.join(ids, "event_id"))
    major = ag.majority_identity(rows, ["meta"], "orientation", "identity")
    stage = rows.where("identity is not null").groupBy("identity").agg(F.min("stage").alias("stage"))
    major = major.join(stage, "identity", "left")
    side = lambda o, c: F.max(F.when(F.col("orientation") == o, F.col(c)))
    wide = major.groupBy("meta").agg(side("PLUS", "identity").alias("plus"), side("MINUS", "identity").alias("minus"), side("PLUS", "stage").alias("ps"), side("MINUS", "stage").alias("ms"))
    first, second = (stages + [("", None), ("", None)])[0][0], (stages + [("", None), ("", None)])[1][0]
    c = F.col
    typed = wide.withColumn("ins_type", retro.mobile_type(c("plus"), c("minus"), c("ps") == first, c("ms") == first, c("ps") == second, c("ms") == second))
    spans = rows.groupBy("meta").agg(F.first("ref").alias("ref"), F.min("beg").alias("beg"), F.max("end").alias("end"), ag.unanimous(F.col("orientation"), "PLUS", "MINUS", "RECIPROCAL").alias("orientation"))
    return spans.join(ag.support(rows, ["meta"]), "meta").join(typed.drop("ps", "ms"), "meta", "left")
