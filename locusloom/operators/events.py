"""The event scan: alignments to insertions, deletions, clippings and discordant pairs.

Alignments are a table like that of `sources.formats.read_sam`, with a `sample` column where tumour and normal were
put together. All filters are plain predicates, so those on ref, position and quality reach the scan; events come
from array expressions over one row's CIGAR, so the scan shuffles nothing and keeps only the columns it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import cigar as cg
from .intervals import overlaps


def in_region(reads: DataFrame, ref: str | None = None, beg: int | None = None, end: int | None = None) -> DataFrame:
    """Alignments that touch a region; each bound is optional."""
    out = reads if ref is None else reads.where(F.col("ref") == ref)
    out = out if end is None else out.where(F.col("beg") <= end)
    return out if beg is None else out.where(F.col("end") >= beg)


def ingest(reads: DataFrame, path: str) -> None:
    """Alignments as a table in order of (ref, beg), so that the bounds of a region skip files and row groups."""
    reads.repartitionByRange("ref", "beg").sortWithinPartitions("ref", "beg").write.mode("overwrite").parquet(path)


def both_clipped(ops: Column) -> Column:
    return (cg.left_clip(ops) > 0) & (cg.right_clip(ops) > 0)


def usable_reads(reads: DataFrame, conf: EngineConf, supplementary: bool = True) -> DataFrame:
    """Mapped alignments with a sequence that pass the configured filters, with their operations in `ops`."""
    flag = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    rows = reads.where(flag("is_unmapped") & F.col("seq").isNotNull() & ~F.col("seq").isin("", "*") & (F.col("mapq") >= conf.min_mapq))
    if conf.filter_duplicates:
        rows = rows.where(flag("is_dup"))
    if not supplementary:
        rows = rows.where(flag("is_supplementary"))
    if "mateUnmap" in conf.read_filters:
        rows = rows.where(flag("mate_unmapped"))
    rows = rows.withColumn("ops", cg.cigar_ops("cigar"))
    if "SMS" in conf.read_filters:
        rows = rows.where(~both_clipped(F.col("ops")))
    return rows


def paired(tumour: DataFrame, normal: DataFrame) -> DataFrame:
    return tumour.withColumn("sample", F.lit("TUMOUR")).unionByName(normal.withColumn("sample", F.lit("NORMAL")))


EVENT_COLUMNS = ["read_name", "ref", "beg", "end", "len", "sv_type", "side", "read_pos", "mapq", "is_reverse", "is_dup", "is_supplementary", "pair", "sample", "mate_ref", "mate_start", "mate_reverse", "insert_size", "sa", "orientation"]


def _shape(rows: DataFrame, **made: Column) -> DataFrame:
    base = rows.withColumn("pair", F.when(F.col("is_first"), 1).otherwise(2))
    base = base if "sample" in base.columns else base.withColumn("sample", F.lit(None).cast("string"))
    for name in ("side", "orientation"):
        made.setdefault(name, F.lit(None).cast("string"))
    made.setdefault("read_pos", F.lit(None).cast("bigint"))
    return base.select(*[(made[c].alias(c) if c in made else F.col(c)) for c in EVENT_COLUMNS])


def insertions_deletions(rows: DataFrame, least: int) -> DataFrame:
    got = cg.indels(rows, "ops", "beg", least)
    return _shape(got, beg=F.col("ref_pos"), end=F.col("ref_end"), len=F.col("n").cast("bigint"), sv_type=F.col("sv_type"), read_pos=F.col("read_pos"))


def clippings(rows: DataFrame, least: int) -> DataFrame:
    got = cg.clip_events(rows, "ops", "beg", "end", least)
    at = F.when(F.col("clipped_side") == "left", F.col("clip_len").cast("bigint")).otherwise((cg.read_length(F.col("ops")) - F.col("clip_len")).cast("bigint"))
    return _shape(
        got, beg=F.col("clip_pos"), end=F.col("clip_pos"), len=F.col("clip_len").cast("bigint"), sv_type=F.lit("CLIPPING"), side=F.col("clipped_side"), read_pos=at,
        orientation=F.when(F.col("clipped_side") == "right", "PLUS").otherwise("MINUS"),
    )


def discordants(rows: DataFrame, conf: EngineConf) -> DataFrame:
    """One event per block of an alignment that is not properly paired."""
    odd = rows.where(F.col("is_paired") & ~F.col("is_proper"))
    if "insertSize" in conf.read_filters:
        odd = odd.where((F.col("insert_size") == 0) | (F.abs("insert_size") >= conf.min_insert_size))
    got = cg.blocks(odd, "ops", "beg")
    return _shape(
        got, beg=F.col("block_beg"), end=F.col("block_end"), len=F.col("block_end") - F.col("block_beg"), sv_type=F.lit("DISCORDANT"), orientation=F.when(F.col("is_reverse"), "MINUS").otherwise("PLUS")
    )


def collect_events(reads: DataFrame, conf: EngineConf, supplementary: bool = True) -> DataFrame:
    """All configured event types of the usable alignments, in EVENT_COLUMNS."""
    rows = usable_reads(reads, conf, supplementary)
    out = []
    if {"INS", "DEL"} & set(conf.target_events):
        out.append(insertions_deletions(rows, conf.min_indel_len).where(F.col("sv_type").isin(*conf.target_events)))
    if "CLIPPING" in conf.target_events:
        out.append(clippings(rows, conf.min_clipping_len))
    if "DISCORDANT" in conf.target_events:
        out.append(discordants(rows, conf))
    all_ = out[0]
    for df in out[1:]:
        all_ = all_.unionByName(df)
    return all_


def count_reads(reads: DataFrame, conf: EngineConf, strand: str | None = None) -> DataFrame:
    """(ref, n) of usable alignments, of one strand if asked."""
    rows = usable_reads(reads, conf)
    rows = rows if strand is None else rows.where(F.col("is_reverse") == (strand == "-"))
    return rows.groupBy("ref").agg(F.count("*").alias("n"))


def mean_mapq(reads: DataFrame, names: DataFrame, ref: str, beg: int, end: int) -> DataFrame:
    """Mean mapping quality of the named reads in an interval."""
    return in_region(reads, ref, beg, end).join(names.select("read_name").distinct(), "read_name", "left_semi").agg(F.avg("mapq").alias("mapq"))


def read_size(reads: DataFrame, rows: int = 500) -> DataFrame:
    """Most frequent read length of the first reads by position and name, the least of equals: a limit by design."""
    n = reads.where("seq is not null").orderBy("ref", "beg", "read_name", F.length("seq")).limit(rows).groupBy(F.length("seq").alias("size")).count()
    return n.orderBy(F.desc("count"), "size").limit(1).select("size")


def clipped_interval(ops: Column, reverse: Column, side: Column) -> Column:
    """struct(beg, end): the clipped part in the read's own direction."""
    total = cg.read_length(ops)
    n = F.when(side == "left", cg.left_clip(ops)).otherwise(cg.right_clip(ops))
    front = (side == "left") != reverse
    return F.when(front, F.struct(F.lit(0).alias("beg"), n.alias("end"))).otherwise(F.struct((total - n).alias("beg"), total.alias("end")))


def supplementary_candidates(clips: DataFrame, key: str, interval: str, sa: str) -> DataFrame:
    """(key, SA fields..., q_beg, q_end): other alignments of a clipped read whose own read interval overlaps the
    clipped one."""
    rows = clips.select(key, F.col(interval).alias("__i"), F.explode(cg.parse_sa(F.col(sa))).alias("s")).select(key, "__i", "s.*")
    q = cg.query_interval(cg.cigar_ops("cigar"), F.col("strand"))
    rows = rows.withColumn("__q", q).where(overlaps("__i.beg", "__i.end", "__q.beg", "__q.end"))
    return rows.select(key, "ref", "beg", "end", "strand", "cigar", "mapq", "nm", F.col("__q.beg").alias("q_beg"), F.col("__q.end").alias("q_end"))


def order_supplementary(chained: DataFrame, key: str, clip_beg: str, clip_end: str, least_gap: int = 50) -> DataFrame:
    """Chain members next to a clipping with read_index by distance from it (from 0), and insert_size: the gap to the
    nearest one where it is at least least_gap."""
    gap = F.greatest(F.col("q_beg") - F.col(clip_end), F.col(clip_beg) - F.col("q_end"), F.lit(0))
    w = Window.partitionBy(key).orderBy("__gap", "q_beg")
    rows = chained.withColumn("__gap", gap).withColumn("read_index", F.row_number().over(w) - 1)
    return rows.withColumn("insert_size", F.when((F.col("read_index") == 0) & (F.col("__gap") >= least_gap), F.col("__gap"))).drop("__gap")


def sa_as_discordants(clips: DataFrame, read_len: int, near: int = 5000, skip_near: bool = True) -> DataFrame:
    """Clippings with supplementary alignments as discordant events: the event spans what the read would cover
    beside the clipping, its mate is the supplementary alignment; those near on the same ref may be left out."""
    rows = clips.withColumn("__s", F.explode(cg.parse_sa(F.col("sa"))))
    if skip_near:
        rows = rows.where((F.col("__s.ref") != F.col("ref")) | (F.abs(F.col("__s.beg") - F.col("beg")) >= near))
    rest = F.lit(read_len) - F.col("len")
    right = F.col("side") == "right"
    return rows.withColumn("__b", F.when(right, F.col("beg") - rest).otherwise(F.col("beg"))).withColumn("__e", F.when(right, F.col("beg")).otherwise(F.col("beg") + rest)).select(
        *[c for c in EVENT_COLUMNS if c not in ("beg", "end", "sv_type", "mate_ref", "mate_start", "mate_reverse", "len")],
        F.col("__b").alias("beg"), F.col("__e").alias("end"), (F.col("__e") - F.col("__b")).alias("len"), F.lit("DISCORDANT").alias("sv_type"),
        F.col("__s.ref").alias("mate_ref"), F.col("__s.beg").alias("mate_start"), (F.col("__s.strand") == "-").alias("mate_reverse"),
    ).select(*EVENT_COLUMNS)


def full_read_name(name: Column, pair: Column, mate: bool = False) -> Column:
    return F.concat_ws("/", name, (F.lit(3) - pair if mate else pair).cast("string"))


def breakpoint_area(events: DataFrame, key: str, side: str, buffer: int, edge: int = 5) -> DataFrame:
    """(key, area_beg, area_end, from_clip): where the breakpoint of one side of a discordant cluster is sought. With
    clipped discordant reads: edge around their clipped ends; else from the cluster's end (PLUS) or begin (MINUS)
    out to buffer. Events have beg, end and clip (whether that end is clipped)."""
    pos = F.col("end") if side == "PLUS" else F.col("beg")
    g = events.groupBy(key).agg(F.min(F.when(F.col("clip"), pos)).alias("__lo"), F.max(F.when(F.col("clip"), pos)).alias("__hi"), F.min("beg").alias("__b"), F.max("end").alias("__e"))
    has = F.col("__lo").isNotNull()
    lo = F.col("__b") if side == "PLUS" else F.col("__b") - buffer
    hi = F.col("__e") + buffer if side == "PLUS" else F.col("__e")
    return g.select(key, F.greatest(F.when(has, F.col("__lo") - edge).otherwise(lo), F.lit(0)).alias("area_beg"), F.when(has, F.col("__hi") + edge).otherwise(hi).alias("area_end"), has.alias("from_clip"))


def representative(clips: DataFrame, key: str, ref_part: str, clip_part: str) -> DataFrame:
    """Per key the clipping with the longest clipped part, as text (ties: the lesser text)."""
    from .retro import clip_text

    rows = clips.withColumn("__t", clip_text(F.col(ref_part), F.col(clip_part), F.col("side")))
    return rows.groupBy(key).agg(F.min_by("__t", F.struct(-F.length(clip_part), "__t")).alias("text"))


def integration_sites(hits: DataFrame, identity: list[str]) -> DataFrame:
    """accession -> begin of hits whose target name starts with one of the identities (`identity|accession|...`)."""
    f = F.split("t_name", r"\|")
    return hits.where(F.get(f, F.lit(0)).isin(*identity)).groupBy(F.get(f, F.lit(1)).alias("accession")).agg(F.min("t_beg").alias("t_beg"))


def label_by_read(events: DataFrame, labels: DataFrame, default: str = "None") -> DataFrame:
    """Events labelled by read name (labels: read_name, label; the least label of several), e.g. by viral hits."""
    one = labels.groupBy("read_name").agg(F.min("label").alias("label"))
    return events.join(one, "read_name", "left").withColumn("label", F.coalesce("label", F.lit(default)))


def label_groups_by_kind(labelled: DataFrame, prefix: str = "DISCORDANT", label: str = "label") -> DataFrame:
    """(kind, n_events, n_reads): labelled events counted per `prefix-label`, as the viral short-read path groups them."""
    kind = F.concat_ws("-", F.lit(prefix), F.col(label)).alias("kind")
    once = labelled.groupBy(kind, "read_name").agg(F.count("*").alias("__n"))
    return once.groupBy("kind").agg(F.sum("__n").alias("n_events"), F.count("read_name").alias("n_reads"))


def overlap_assembly(pairs: DataFrame, most: int = 250) -> DataFrame:
    """(key, contig): for read pairs with overlap hits (key, seq_a, seq_b, a_len, a_end, b_beg, b_end, strand, q_beg):
    of the hits on + whose ends lie within `most` of the reads' ends the longest joins the two reads."""
    ok = pairs.where((F.col("strand") == "+") & (F.col("a_len") - F.col("a_end") <= most) & (F.col("b_beg") <= most))
    contig = F.concat(F.substring("seq_a", F.lit(1), F.col("a_end")), F.substring("seq_b", F.col("b_end") + 1, F.length("seq_b")))
    return ok.withColumn("__c", contig).groupBy("key").agg(F.max_by("__c", F.struct(F.col("a_end") - F.col("q_beg"), "__c")).alias("contig"))


def shift_coords(events: DataFrame, ref: Column | str, offset: Column | int) -> DataFrame:
    """Events called on a target region, in the coordinates of the genome: ref replaced, positions and those of the
    supplementary alignments in `sa` moved by offset."""
    to = F.lit(ref) if isinstance(ref, str) else ref
    by = F.lit(offset) if isinstance(offset, int) else offset
    items = F.filter(F.split(F.coalesce("sa", F.lit("")), ";"), lambda x: x != "")

    def move(x):
        f = F.split(x, ",")
        head = F.array(to, (F.get(f, F.lit(1)).try_cast("bigint") + by).cast("string"))
        return F.array_join(F.concat(head, F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0)))), ",")

    sa = F.when(F.col("sa").isNotNull(), F.concat(F.array_join(F.transform(items, move), ";"), F.when(F.size(items) > 0, ";").otherwise("")))
    return events.withColumn("sa", sa).withColumn("ref", to).withColumn("beg", F.col("beg") + by).withColumn("end", F.col("end") + by)


def supporting_clippings(areas: DataFrame, clips: DataFrame, key: str, side: str) -> DataFrame:
    """(key, clipping columns): clippings of one side whose breakpoint lies in the key's area (ref, area_beg,
    area_end)."""
    from .intervals import range_join

    left = areas.select(key, "ref", F.col("area_beg").alias("beg"), F.col("area_end").alias("end"))
    right = clips.where(F.col("side") == side).select(*[F.col(c).alias(f"c_{c}") for c in clips.columns if c not in ("ref", "beg")], F.col("ref").alias("r_ref"), F.col("beg").alias("r_beg"), F.col("beg").alias("r_end"))
    rest = [c for c in clips.columns if c not in ("ref", "beg")]
    return range_join(left, right).select(key, F.col("r_ref").alias("ref"), F.col("r_beg").alias("beg"), *[F.col(f"c_{c}").alias(c) for c in rest])


def near_matched(clips: DataFrame, matched: DataFrame, key: str, edge: int = 5) -> DataFrame:
    """Clippings of a key within `edge` of the span of its matched clippings' breakpoints."""
    span = matched.groupBy(key).agg((F.min("beg") - edge).alias("__lo"), (F.max("beg") + edge).alias("__hi"))
    return clips.join(span, key).where(F.col("beg").between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def best_source(clips: DataFrame, key: str, source: str = "source", order: tuple[str, ...] = ("discordant", "matched", "regular")) -> DataFrame:
    """Of each key's clippings those of the best source that it has."""
    rank = F.coalesce(*[F.when(F.col(source) == s, F.lit(i)) for i, s in enumerate(order)], F.lit(len(order)))
    rows = clips.withColumn("__rank", rank)
    best = rows.groupBy(key).agg(F.min("__rank").alias("__best"))
    return rows.join(best, key).where("__rank = __best").drop("__rank", "__best")


def inserted_between(seq: Column, a: Column, b: Column) -> Column:
    """Bases of a read between two breakpoints, in either order."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.substring(seq, lo + 1, hi - lo)


def as_mates(events: DataFrame) -> DataFrame:
    """Each discordant event seen from its mate: positions, orientation and pair number exchanged."""
    flipped = cg.swap_mate(events, ["ref", "beg", "is_reverse"], ["mate_ref", "mate_start", "mate_reverse"])
    return flipped.withColumn("pair", F.lit(3) - F.col("pair")).withColumn("end", F.col("beg") + F.col("len")).withColumn("orientation", F.when(F.col("is_reverse"), "MINUS").otherwise("PLUS"))
