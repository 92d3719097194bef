"""Breakpoints of discordant clusters from the clippings around them, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .events import best_source, breakpoint_area, representative, supporting_clippings

#: The side of a clipping that shows the breakpoint behind discordant reads of an orientation.
SIDES = {"PLUS": "right", "MINUS": "left"}


def _source(near: DataFrame, key: str, clipped_reads: DataFrame, matched: DataFrame | None) -> DataFrame:
    """near with `source`: `discordant` for clippings of reads that are clipped discordant ones of the cluster,
    `matched` for those whose bases matched the cluster's identity, else `regular`."""
    own = clipped_reads.select(F.col(key), F.col("read_name"), F.lit(True).alias("__own")).distinct()
    rows = near.join(own, [key, "read_name"], "left")
    hit: Column = F.lit(False)
    if matched is not None:
        on = [c for c in (key, "clip_id") if c in matched.columns]
        rows = rows.join(matched.select(*on, F.lit(True).alias("__hit")).distinct(), on, "left")
        hit = F.coalesce("__hit", F.lit(False))
    source = F.when(F.col("__own"), "discordant").when(hit, "matched").otherwise("regular")
    return rows.withColumn("source", source).drop("__own", "__hit")


def analyse(discordants: DataFrame, clips: DataFrame, key: str, buffer: int, matched: DataFrame | None = None, edge: int = 5) -> DataFrame:
    """(key, side, area_beg, area_end, from_clip, n_clips, source, breakpoint, text), one row per cluster and
    orientation that has discordant reads.

    discordants: (key, ref, beg, end, orientation, clip, read_name), clip saying whether the end that shows the
    breakpoint is clipped; clips: (clip_id, ref, beg, side, read_name, ref_part, clip_part); matched: (key, clip_id), or
    (clip_id) of clippings that match whatever the cluster.
    Clippings of the side are sought in the area of `breakpoint_area`; of those found the ones of the best source
    count (clipped discordant reads, then matched, then any). The breakpoint is their most frequent position, the
    least of several; the text is that of the longest clipped part. Without clippings both are null. Null reads match
    nothing; repeated clippings count as often as they occur.
    """
    out = None
    for side, at in SIDES.items():
        own = discordants.where(F.col("orientation") == side)
        refs = own.groupBy(key).agg(F.min("ref").alias("ref"))
        areas = settle(breakpoint_area(own, key, side, buffer, edge).join(refs, key))
        near = supporting_clippings(areas, clips, key, at)
        best = settle(best_source(_source(near, key, own.where("clip"), matched), key))
        counts = best.groupBy(key, "beg").agg(F.count("*").alias("__n"), F.min("source").alias("source"))
        mode = counts.groupBy(key).agg(F.min_by("beg", F.struct(-F.col("__n"), F.col("beg"))).alias("breakpoint"), F.sum("__n").alias("n_clips"), F.min("source").alias("source"))
        text = representative(best, key, "ref_part", "clip_part")
        got = areas.join(mode, key, "left").join(text, key, "left").select(
            key, F.lit(side).alias("side"), "area_beg", "area_end", "from_clip", F.coalesce("n_clips", F.lit(0).cast("bigint")).alias("n_clips"), "source", "breakpoint", "text"
        )
        out = got if out is None else out.unionByName(got)
    return out
