"""Per-key results that do not depend on how the rows spread over the keys.

Counts and bounds combine before the shuffle; distinct counts shuffle on (key, value). Quantiles are exact and come
from distributed selection: a histogram of the leading bits of the values is counted per key, the bin that holds
the wanted rank is kept and split again, until a bin is one value. What moves are counts, never a key's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, settle

#: Bits resolved in one pass: at most 2^BITS counters per key and pass.
BITS = 12
SALTS = 64


def selected(df: DataFrame, key: str, value: str, probs: Sequence[float], bits: int = BITS) -> DataFrame:
    """Rows (key, prob_k int, value bigint, n, n_rows): for each key and prob_k = round(1000 * prob) the value at rank
    ceil(prob * n) of its n non-null values, read off histograms alone; n_rows counts the key's rows, those of null
    value included, and is the sum of its first histogram. A key without values has null values and n = 0.

    The last refinement is left to the query that uses the result; those before it are settled, as each is read twice.
    """
    rows = df.select(F.col(key).alias("__k"), F.col(value).cast("bigint").alias("__v"))
    lo, hi = rows.agg(F.min("__v"), F.max("__v")).first()
    width = 1 if lo is None else max(1, (hi - lo).bit_length())
    left = max(0, width - bits)  # the first pass has at most 2^bits + 1 bins a key
    first = settle(rows.groupBy("__k", F.shiftright("__v", left).alias("__bin")).agg(F.count("*").alias("__c")))
    keys = first.groupBy("__k").agg(F.sum("__c").alias("__rows"), F.coalesce(F.sum(F.expr("if(__bin is null, 0, __c)")), F.lit(0).cast("bigint")).alias("__n"))
    wanted = F.explode(F.array(*[F.lit(int(round(p * 1000))) for p in probs]))
    ranked = keys.withColumn("prob_k", wanted).withColumn("__r", F.expr("greatest(1, (prob_k * __n + 999) div 1000)"))
    # a key without values has one empty histogram and keeps the null
    upto = F.sum(F.expr("if(__bin is null, 0, __c)")).over(Window.partitionBy("__k").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = first.withColumn("__upto", upto).withColumn("__from", F.expr("if(__bin is null, __upto, __upto - __c)"))
    hit = F.expr("h.__k <=> r.__k and ((r.__r > h.__from and r.__r <= h.__upto) or (r.__n = 0 and h.__bin is null))")
    active = bins.alias("h").join(ranked.alias("r"), hit).select("r.__k", "r.__rows", "r.__n", "r.prob_k", F.expr("r.__r - h.__from").alias("__r"), F.col("h.__bin").alias("__p"))
    while left > 0:
        active = settle(active)
        step = min(bits, left)
        left -= step
        open_ = active.where("__p is not null").select("__k", F.col("__p").alias("__pre")).distinct()
        v = rows.where("__v is not null").select("__k", F.shiftright("__v", left).alias("__bin")).withColumn("__pre", F.shiftright("__bin", step))
        if open_.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            inside = v.join(F.broadcast(open_), [v["__k"].eqNullSafe(open_["__k"]), v["__pre"] == open_["__pre"]], "left_semi")
        else:
            salted = v.withColumn("__salt", (F.rand(7) * SALTS).cast("int"))
            spread = open_.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            inside = salted.join(
                spread,
                [salted["__k"].eqNullSafe(spread["__k"]), salted["__pre"] == spread["__pre"], salted["__salt"] == spread["__salt"]],
                "left_semi",
            )
        counts = inside.groupBy("__k", "__pre", "__bin").agg(F.count("*").alias("__c"))
        w = Window.partitionBy("__k", "__pre").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("__upto", F.sum("__c").over(w))
        a, c = active.alias("a"), counts.alias("c")
        found = a.join(c, F.expr("a.__k <=> c.__k and a.__p = c.__pre and a.__r > c.__upto - c.__c and a.__r <= c.__upto")).select(
            "a.__k", "a.__rows", "a.__n", "a.prob_k", F.expr("a.__r - (c.__upto - c.__c)").alias("__r"), F.col("c.__bin").alias("__p")
        )
        active = found.unionByName(active.where("__p is null"))
    return active.select(F.col("__k").alias(key), "prob_k", F.col("__p").alias("value"), F.col("__n").alias("n"), F.col("__rows").alias("n_rows"))


def exact_quantiles(df: DataFrame, key: str, value: str, probs: Sequence[float], bits: int = BITS) -> DataFrame:
    """Rows (key, prob_k int, value bigint, n): for each key and prob_k = round(1000 * prob) the value at rank ceil(prob * n).

    `value` is an integer column; null values are not counted and a key without values has no row. A null key is
    a key of its own. Ties and repeated rows count as often as they occur. An empty input gives an empty result.
    """
    return selected(df, key, value, probs, bits).where("n > 0").drop("n_rows")


def newest_per_id(df: DataFrame, id_col: str, order: str, keep: dict[str, Column]) -> DataFrame:
    """One row per non-null id: the columns `keep` of its row latest in `order` (null first; ties: greatest row)."""
    body = F.struct(F.col(order).alias("__o"), *[c.alias(n) for n, c in keep.items()])
    got = df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(body).alias("__m"))
    return got.select("__id", *[F.col(f"__m.{n}").alias(n) for n in keep])


def _name(p: float) -> str:
    k = int(round(p * 1000))
    return f"q{k // 10 if k % 10 == 0 else k}"


def key_profile(
    df: DataFrame,
    id_col: str,
    order: str,
    key: Column,
    distinct: Column,
    lo: Column,
    hi: Column,
    value: Column,
    probs: Sequence[float] = (0.5,),
    min_share: float = 0.0,
) -> DataFrame:
    """One row per key: (hot_key, n_ids, n_distinct, lo, hi, q50...) over the newest row of each id.

    Only ids with a non-null key count. n_distinct leaves out nulls; lo and hi are the least and greatest values
    and skip nulls; a quantile is null where a key has no value. Counts and quantiles come from the histograms of
    `selected`. With min_share only keys holding at least that share of all counted ids are returned. Input columns
    beyond the given expressions are not read; an empty input gives an empty result.
    """
    keep = {"k": key, "d": distinct, "lo": lo, "hi": hi, "v": value}
    ids = settle(newest_per_id(df.where(key.isNotNull()), id_col, order, keep))
    quant = selected(ids, "k", "v", probs)
    wide = quant.groupBy("k").agg(F.max("n_rows").alias("n_ids"), *[F.max(F.when(F.col("prob_k") == int(round(p * 1000)), F.col("value"))).alias(_name(p)) for p in probs])
    if min_share > 0:
        wide = wide.where(F.col("n_ids") >= F.lit(min_share) * ids.count())
    bounds = ids.groupBy("k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    seen = ids.where("d is not null").groupBy("k", "d").agg(F.lit(1)).groupBy("k").agg(F.count("*").alias("n_distinct"))
    out = wide.join(bounds, "k").join(seen, "k", "left")
    return out.select(F.col("k").alias("hot_key"), "n_ids", F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct"), "lo", "hi", *[_name(p) for p in probs])


def hot_keys(df: DataFrame, id_col: str, order: str, key: Column, value: Column, min_share: float, prob: float = 0.5) -> DataFrame:
    """(hot_key, n_ids, value): the keys that hold at least `min_share` of all ids with a non-null key, with the
    quantile of their values (null without any). Both come from the selection's histograms, made for all keys. An
    empty input gives an empty result."""
    ids = settle(newest_per_id(df.where(key.isNotNull()), id_col, order, {"k": key, "v": value}))
    got = selected(ids, "k", "v", [prob])
    return got.where(F.col("n_rows") >= F.lit(min_share) * ids.count()).select(F.col("k").alias("hot_key"), F.col("n_rows").alias("n_ids"), "value")
