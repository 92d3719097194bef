"""Records of several sources as one mix in which each source has its target share of the total size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_checked, settle
from .ranks import blocks_for, with_position

#: Copies are counted in units of 2^-32, so prefix sums are exact integers.
UNIT = 1 << 32
SEED = 20240


def source_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), "-", "_")


def plan_mix(docs: DataFrame, targets: DataFrame, source_col: str, size_col: str) -> DataFrame:
    """Per row of `targets` (source_name, target_share, max_repeats): its place `target_no`, key, n_docs, size (of all
    documents of the source), need (the share of the sum of all sizes) and rate, the expected copies of each document
    in UNIT: need / size, but at most max_repeats. A null share or cap counts as 0; repeated rows are one target."""
    want = targets.select("source_name", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).distinct()
    want = want.withColumn("key", source_key(F.col("source_name")))
    have = settle(
        docs.where(F.col(source_col).isNotNull())
        .groupBy(source_key(F.col(source_col)).alias("key"))
        .agg(F.sum(size_col).cast("bigint").alias("size"), F.count("*").alias("n_docs"))
    )
    # a source that several targets name counts once
    total = have.join(want.select("key").distinct(), "key", "left_semi").agg(F.sum("size")).first()[0] or 0
    zero = F.lit(0).cast("bigint")
    plan = want.join(have, "key", "left").withColumn("size", F.coalesce("size", zero)).withColumn("n_docs", F.coalesce("n_docs", zero)).withColumn("need", F.col("target_share") * F.lit(float(total)))
    # documents of no size cannot meet a need, however often they are used
    rate = F.when(F.col("need") > 0, F.least(F.try_divide(F.col("need"), F.col("size")), F.col("max_repeats").cast("double")))
    plan = plan.withColumn("rate", F.coalesce((rate * UNIT).cast("bigint"), zero))
    return plan.withColumn("target_no", F.row_number().over(Window.orderBy("source_name", "target_share", "max_repeats")))  # a few rows


def draw(docs: DataFrame, plan: DataFrame, id_col: str, key: str, size_col: str, seed: int = SEED) -> DataFrame:
    """(target_no, source_name, id, size, copies): how often each document of a target is used, 0 included.

    Inside a source the documents stand in an order of hashed blocks and, in them, of size; each adds `rate` to a
    running sum that starts at one random offset, and is used once per integer that the sum crosses: floor or ceil
    of its expected copies, so never beyond the cap, and exactly the cap where the rate is the cap."""
    most = docs.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    placed = with_position(docs.where(F.col(key).isNotNull()), key, F.struct(F.col(id_col), F.lit(seed)), [size_col, id_col], blocks_for(int(most)))
    offset = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(UNIT))
    rates = plan.select(F.col("key").alias("__key"), "target_no", "source_name", "rate")
    run = placed.join(broadcast_checked(rates), F.col(key) == F.col("__key"))
    upto = lambda p: F.floor((p * F.col("rate").cast("decimal(20,0)") + offset) / F.lit(UNIT)).cast("bigint")
    before, after = upto(F.col("position").cast("decimal(18,0)")), upto((F.col("position") + 1).cast("decimal(18,0)"))
    return run.select("target_no", "source_name", F.col(id_col), F.col(size_col), (after - before).cast("int").alias("copies"))


def report(drawn: DataFrame, plan: DataFrame, size_col: str) -> DataFrame:
    """Per target what the draw gave: n_used, most_copies, actual (the size of all copies), actual_share and outcome.

    The outcome is read off the draw. `short`: every document is used as often as the cap allows, and that is less
    than the need. Else `repeat`: every document is used, and some of them more than once, or once each and that is
    less than the need. Else `cut`. As a rate above one uses every document, one up to one none of them twice, and
    one held down by the cap all of them to the cap, these are the cases size * cap < need, size < need and the rest."""
    used = drawn.groupBy("target_no").agg(
        F.sum("copies").alias("n_used"), F.min("copies").alias("least_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col(size_col)).alias("actual")
    )
    got = plan.join(used, "target_no", "left")
    actual = F.coalesce("actual", F.lit(0).cast("bigint"))
    at_cap = F.coalesce(F.col("least_copies") == F.col("max_repeats"), F.lit(True))
    below = actual < F.col("need")
    outcome = F.when(at_cap & below, "short").when((F.col("least_copies") >= 1) & ((F.col("most_copies") > 1) | below), "repeat").otherwise("cut")
    every = F.sum("actual").over(Window.partitionBy(F.lit(0)))  # over one row per target
    return got.withColumn("__all", every).select(
        "source_name", "target_share", "max_repeats", "n_docs", "size", F.round("need", 3).alias("need"), outcome.alias("outcome"),
        F.coalesce("n_used", F.lit(0).cast("bigint")).alias("n_used"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), actual.alias("actual"),
        F.round(F.coalesce(F.try_divide(F.col("actual"), F.col("__all")), F.lit(0.0)), 6).alias("actual_share"),
    )


def mix(docs: DataFrame, targets: DataFrame, id_col: str, source_col: str, size_col: str, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: (source_name, id, copy_no, size), one row per use of a document; report: per target its
    plan and what came out (see `report`).

    Documents of a null or untargeted source are left out, as are null sizes; documents of size 0 are drawn like
    others; repeated rows are documents of their own. Without documents the mix is empty and no target needs any.
    """
    rows = docs.where(F.col(size_col).isNotNull()).select(F.col(id_col).alias("__i"), source_key(F.col(source_col)).alias("__k"), F.col(size_col).cast("bigint").alias("__s"))
    plan = settle(plan_mix(rows, targets, "__k", "__s"))
    drawn = draw(rows, plan, "__i", "__k", "__s", seed)
    emitted = drawn.where("copies > 0").select("source_name", F.col("__i").alias(id_col), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), F.col("__s").alias("size"))
    return emitted, report(drawn, plan, "__s")
