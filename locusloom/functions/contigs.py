"""Names of reference contigs: spelling rules and the mapping of any accepted name to the canonical one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_checked


def squeeze(c: Column) -> Column:
    """Text without surrounding white space (space, tab, line breaks); null stays null."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def name_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def contig_names(contigs: DataFrame) -> DataFrame:
    """One row (name_key, contig) per accepted spelling; a name claimed by several contigs goes to the least."""
    names = contigs.select(
        F.col("ref_name").alias("contig"), F.explode(F.array("ref_name", "alias_name", "accession")).alias("n")
    ).where("n is not null")
    return names.groupBy(name_key(F.col("n")).alias("name_key")).agg(F.min("contig").alias("contig"))


def with_contig(df: DataFrame, contigs: DataFrame, col: str, out: str = "contig", how: str = "inner") -> DataFrame:
    """df with the canonical contig name of column `col` in `out`; rows of unknown or null names are dropped
    (how='inner') or get null (how='left'). An existing column `out` is replaced."""
    names = contig_names(contigs).select(
        F.col("name_key").alias("__name_key"), F.col("contig").alias("__contig")
    )
    base = df.drop(out) if out in df.columns and out != col else df
    joined = base.join(broadcast_checked(names, within=contigs), name_key(F.col(col)) == F.col("__name_key"), how)
    return joined.withColumn(out, F.col("__contig")).drop("__name_key", "__contig")
