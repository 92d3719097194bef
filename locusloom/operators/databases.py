"""Sequence collections that insertions are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import fetch


def consensus_db(library: DataFrame, families: DataFrame) -> DataFrame:
    """(seq_id, seq): library records (`subfamily#...`) of the listed subfamilies (subfamily, family), renamed to
    `consensus|family|subfamily`, without the run of A at the 3' end."""
    sub = F.get(F.split("seq_id", "#"), F.lit(0))
    rows = library.withColumn("subfamily", sub).join(families.dropDuplicates(["subfamily"]), "subfamily")
    return rows.select(F.concat_ws("|", F.lit("consensus"), "family", "subfamily").alias("seq_id"), F.regexp_replace("seq", "[Aa]+$", "").alias("seq"))


def transduced_db(sources: DataFrame, chunks: DataFrame, chunk: int, size: int = 15_000) -> DataFrame:
    """(seq_id, ref, beg, end, seq): what follows each source element (ref, beg, end, band, family, strand) on its
    strand, named `transduced|family|band|coordinates`."""
    plus = F.col("strand") == "+"
    beg = F.when(plus, F.col("end")).otherwise(F.greatest(F.col("beg") - size, F.lit(0)))
    end = F.when(plus, F.col("end") + size).otherwise(F.col("beg"))
    named = F.concat_ws("|", F.lit("transduced"), "family", "band", F.concat("ref", F.lit(":"), F.col("beg").cast("string"), F.lit("-"), F.col("end").cast("string")))
    regions = sources.select(named.alias("key"), "ref", beg.alias("__b"), end.alias("__e")).select("key", "ref", F.col("__b").alias("beg"), F.col("__e").alias("end"))
    return fetch(regions, chunks, chunk).select(F.col("key").alias("seq_id"), "ref", "beg", "end", "seq")


def joined_db(parts: list[DataFrame]) -> DataFrame:
    """One collection of several, an id once (the first part's)."""
    every = None
    for i, p in enumerate(parts):
        p = p.select("seq_id", "seq").withColumn("__n", F.lit(i))
        every = p if every is None else every.unionByName(p)
    return every.groupBy("seq_id").agg(F.min_by("seq", F.struct("__n", "seq")).alias("seq"))


def identity_db(members: DataFrame, collection: DataFrame, key: str) -> DataFrame:
    """(key, seq_id, seq): per cluster the record of the most frequent specific identity of its members (least of
    equals)."""
    n = members.where("specific is not null").groupBy(key, "specific").agg(F.count("*").alias("__n"))
    top = n.groupBy(key).agg(F.min_by("specific", F.struct(-F.col("__n"), F.col("specific"))).alias("seq_id"))
    return top.join(collection, "seq_id").select(key, "seq_id", "seq")
