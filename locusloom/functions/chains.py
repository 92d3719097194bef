"""Greedy chains of alignment hits."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.grouped import label_groups


def greedy_chain(hits: list[tuple[int, int]], max_dist: float, max_pct: float) -> list[int]:
    """Indexes of the chain in query order. It starts with the longest hit; then, again and again, the first hit in
    order of length that lies beside the chain (near, and sharing at most max_pct of either) joins at its side."""

    if not hits:
        return []
    at = np.array(hits, dtype=np.int64).reshape(-1, 2)
    order = np.lexsort((np.arange(len(at)), at[:, 0] - at[:, 1]))
    b, e = at[order, 0], at[order, 1]
    free = np.ones(len(at), dtype=bool)
    free[0] = False
    chain = deque([0])
    while True:
        lo, hi = b[chain[0]], e[chain[-1]]
        n = np.maximum(0, np.minimum(hi, e) - np.maximum(lo, b) + 1)
        near = (lo - max_dist <= e + max_dist) & (b - max_dist <= hi + max_dist)
        fits = free & near & (_pct(n, hi - lo + 1) <= max_pct) & (_pct(n, e - b + 1) <= max_pct)
        i = int(fits.argmax())
        if not fits[i]:
            return order[list(chain)].tolist()
        free[i] = False
        chain.appendleft(i) if lo > b[i] else chain.append(i)


def _pct(n: np.ndarray, size) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.asarray(n / size * 100)


def chain_hits(df: DataFrame, key: str, beg: str, end: str, tie: list[str], max_dist: float, max_pct: float) -> DataFrame:
    """df's rows that belong to the chain of their key, with chain_no (from 0, in query order). A key's hits are the
    alignments of one query, so a group is small by nature; equal lengths go by begin, then `tie`."""

    def chain(b, e):
        no = np.full(len(b), -1)
        at = greedy_chain(list(zip(b.tolist(), e.tolist())), max_dist, max_pct)
        no[at] = np.arange(len(at))
        return (no,)

    return label_groups(df, [key], [beg, *tie], [beg, end], chain, ["chain_no"]).where("chain_no >= 0")


def chain_summary(chained: DataFrame, key: str, beg: str, end: str, size: str, target: str) -> DataFrame:
    """Per chain: query interval, covered per cent of the query, and its distinct targets."""
    span = F.max_by(F.col(end), "chain_no") - F.min_by(F.col(beg), "chain_no")
    return chained.groupBy(key).agg(
        F.min_by(F.col(beg), "chain_no").alias("chain_beg"), F.max_by(F.col(end), "chain_no").alias("chain_end"), F.count("*").alias("n_hits"),
        F.coalesce(F.try_divide(span * F.lit(100.0), F.first(size)), F.lit(0.0)).alias("pct_covered"), F.array_sort(F.collect_set(target)).alias("targets"),
    )


def alignment_pct(beg: Column, end: Column, size: Column) -> Column:
    return F.try_divide((end - beg) * F.lit(100.0), size)


def mirror_query(strand: Column, beg: Column, end: Column, size: Column) -> Column:
    """struct(strand, beg, end) of a hit seen from the other strand."""
    return F.struct(F.when(strand == "+", "-").otherwise("+").alias("strand"), (size - end).alias("beg"), (size - beg).alias("end"))


def max_hits(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows of keys with at most `most` rows. Counting combines before the shuffle, then decides by a semi join."""
    few = df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") <= most).select(key)
    return df.join(few, key, "left_semi")
