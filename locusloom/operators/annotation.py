"""Annotation of events by interval joins: repeats with distances, cascades, genes, known insertions, mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import overlap_bp, overlap_span, overlaps, range_join


def repeat_distances(events: DataFrame, repeats: DataFrame, key: str, buffer: int = 200) -> DataFrame:
    """(key, family, subfamily, distance) of repeats within buffer: 0 where the bare intervals overlap, else how far
    the shared stretch of the widened event falls short of the buffer. `repeats` has r_ref, r_beg, r_end, family,
    subfamily."""
    pairs = range_join(events.select(key, "ref", "beg", "end"), repeats.select("r_ref", "r_beg", "r_end", "family", "subfamily"), buffer)
    wide = overlap_span(F.col("beg") - buffer, F.col("end") + buffer, "r_beg", "r_end")["bp"]
    return pairs.select(key, "family", "subfamily", F.when(overlaps("beg", "end", "r_beg", "r_end"), F.lit(0)).otherwise(F.abs(wide - buffer)).cast("bigint").alias("distance"))


def repeats_annotation(events: DataFrame, repeats: DataFrame, key: str, buffer: int = 200) -> DataFrame:
    """events with `repeats`, the array of struct(distance, family, subfamily) in that order; empty without any."""
    near = repeat_distances(events, repeats, key, buffer)
    lists = near.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("distance", "family", "subfamily"))).alias("repeats"))
    none = F.expr("cast(array() as array<struct<distance:bigint,family:string,subfamily:string>>)")
    return events.join(lists, key, "left").withColumn("repeats", F.coalesce("repeats", none))


def annotate_interval(events: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Every overlapping feature with the shared stretch and its per cent of the event (length + 1)."""
    pairs = range_join(events, features)
    span = overlap_span("beg", "end", "r_beg", "r_end")
    return pairs.withColumn("shared_beg", span["beg"]).withColumn("shared_end", span["end"]).withColumn("pct", span["bp"] * F.lit(100.0) / (F.col("end") - F.col("beg") + 1))


def known_insertions(events: DataFrame, known: DataFrame, key: str, buffer: int = 150) -> DataFrame:
    """events (with `family`) and `database`: that of the known insertion of the same family within buffer which
    shares most (ties: lower begin, then lesser name); null without one. `known` has r_ref, r_beg, r_end, r_family,
    database."""
    pairs = range_join(events.select(key, "ref", "beg", "end", "family"), known, buffer, [("family", "r_family")])
    shared = overlap_bp(F.col("beg") - buffer, F.col("end") + buffer, "r_beg", "r_end")
    best = pairs.groupBy(key).agg(F.min_by("database", F.struct(-shared, "r_beg", "database")).alias("database"))
    return events.join(best, key, "left")


def gene_annotation(events: DataFrame, genes: DataFrame, key: str, rank: dict[str, int] | None = None) -> DataFrame:
    """events with `region` and `gene`: those of the overlapping gene-model part of the highest priority (exon
    before UTR before intron by default); `intergenic` and null outside. `genes` has r_ref, r_beg, r_end, r_region,
    gene."""
    rank = rank or {"exonic": 0, "UTR5": 1, "UTR3": 2, "intronic": 3}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    pairs = range_join(events.select(key, "ref", "beg", "end"), genes)
    at = F.struct(F.coalesce(F.try_element_at(order, F.col("r_region")), F.lit(99)), F.col("gene"))
    best = pairs.groupBy(key).agg(F.min_by(F.struct("r_region", "gene"), at).alias("__g"))
    return events.join(best, key, "left").select(*events.columns, F.coalesce("__g.r_region", F.lit("intergenic")).alias("region"), F.col("__g.gene").alias("gene"))


def cascade(events: DataFrame, stages: list[tuple[str, DataFrame]], key: str, buffer: int = 0) -> DataFrame:
    """(key, identity, stage): the label of the first stage with an overlapping feature; within a stage the one that
    shares most (ties: lesser label). Stages are tables r_ref, r_beg, r_end, label; features without a label take no
    part. Each event is counted once.

    All stages go through one range join, with the stage as part of the order, so the events are laid out once."""
    every = None
    for i, (name, features) in enumerate(stages):
        f = features.where("label is not null").select("r_ref", "r_beg", "r_end", "label").withColumn("stage", F.lit(name)).withColumn("__stage", F.lit(i))
        every = f if every is None else every.unionByName(f)
    pairs = range_join(events.select(key, "ref", "beg", "end"), every, buffer)
    shared = overlap_bp("beg", "end", "r_beg", "r_end")
    best = pairs.groupBy(key).agg(F.min_by(F.struct("label", "stage"), F.struct("__stage", -shared, "label")).alias("__m"))
    return events.select(key).join(best, key, "left").select(key, F.col("__m.label").alias("identity"), F.col("__m.stage").alias("stage"))


def mate_labels(events: DataFrame, features: DataFrame, key: str, read_size: int = 100) -> DataFrame:
    """(key, label): the feature at the mate's position; `None` as text without one, the one that shares most of
    several. events has mate_ref, mate_start."""
    mates = events.select(key, F.col("mate_ref").alias("ref"), F.col("mate_start").alias("beg"), (F.col("mate_start") + read_size).alias("end"))
    pairs = range_join(mates, features.where("label is not null").select("r_ref", "r_beg", "r_end", "label"))
    best = pairs.groupBy(key).agg(F.min_by("label", F.struct(-overlap_bp("beg", "end", "r_beg", "r_end"), "label")).alias("label"))
    return events.select(key).join(best, key, "left").withColumn("label", F.coalesce("label", F.lit("None")))


def identity_text(labels: Column) -> Column:
    """Several `id|specific` labels as one text: distinct ids in order, joined by `_`."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(labels, lambda x: F.get(F.split(x, r"\|"), F.lit(0))))), "_")


def transduced_regions(sources: DataFrame, ends: list[str], size: int = 10_000, buffer: int = 150) -> DataFrame:
    """Regions beside source elements (ref, beg, end, name, strand) whose sequence an insertion may carry along:
    at the 3' end of + and the 5' end of - elements [end - buffer, end + size], else [beg - size, beg + buffer],
    not below 0."""
    rows = sources.withColumn("src_end", F.explode(F.array(*[F.lit(e) for e in ends])))
    down = ((F.col("strand") == "+") & (F.col("src_end") == "3")) | ((F.col("strand") == "-") & (F.col("src_end") == "5"))
    beg = F.when(down, F.col("end") - buffer).otherwise(F.col("beg") - size)
    end = F.when(down, F.col("end") + size).otherwise(F.col("beg") + buffer)
    return rows.withColumn("__b", F.greatest(beg, F.lit(0))).withColumn("end", end).withColumn("beg", F.col("__b")).drop("__b")
