"""Clusters of intervals: islands by gap, by bin chain and by overlap, the exact reciprocal sweep, and k-means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .grouped import label_groups
from .ordered import number_runs


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str = "cluster_no") -> DataFrame:
    """Numbers runs of rows per key (from 1): a row on which `starts` is true begins a new run."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap_clusters(df: DataFrame, keys: list[str], pos: str, max_dist: int, tie: list[str], out: str = "cluster_no") -> DataFrame:
    """Chains of positions of which each is at most max_dist from the one before (inclusive)."""
    return number_runs(df, keys, pos, tie, F.col(pos), lambda last: last.isNull() | (F.col("__o0") - last > max_dist), out)


def bin_chain_clusters(df: DataFrame, ref: str, beg: str, end: str, size: int, max_dist: int, min_size: int = 1, out: str = "cluster_no") -> DataFrame:
    """Distance clusters over bins: all items of a bin are one cluster, which goes on in the adjacent bin if that
    holds items and its first begin is at most max_dist behind the cluster's last end. Items whose ends fall into
    different bins take no part. Only bins, not items, are ordered; the result is joined back by (ref, bin)."""
    items = df.where(F.expr(f"{beg} div {size} = {end} div {size}")).withColumn("__bin", F.expr(f"{beg} div {size}"))
    bins = settle(items.groupBy(ref, "__bin").agg(F.min(beg).alias("__lo"), F.max(end).alias("__hi"), F.count("*").alias("__n")))
    here = F.struct("__bin", "__hi", "__lo")
    apart = lambda last: last.isNull() | (F.col("__r.__bin") - last["__bin"] != 1) | (F.col("__r.__lo") - last["__hi"] > max_dist)
    chained = number_runs(bins, [ref], "__bin", [], here, apart, out)
    if min_size > 1:
        big = chained.groupBy(ref, out).agg(F.sum("__n").alias("__size")).where(F.col("__size") >= min_size).drop("__size")
        chained = chained.join(big, [ref, out])
    return items.join(chained.select(ref, "__bin", out), [ref, "__bin"]).drop("__bin")


def overlap_components(df: DataFrame, ref: str, beg: str, end: str, buffer: int = 0, tie: list[str] | None = None, out: str = "cluster_no") -> DataFrame:
    """Connected components under closed overlap of the intervals, each widened by buffer."""
    apart = lambda reach: reach.isNull() | (F.col("__o0") - buffer > reach + buffer)
    return number_runs(df, [ref], beg, [end, *(tie or [])], F.col(end), apart, out)


def sweep_reciprocal(beg: np.ndarray, end: np.ndarray, ids: np.ndarray, min_pct: float, buffer: int, min_size: int) -> np.ndarray:
    """Cluster numbers (from 0; -1 for none) of the greedy sweep over one set of intervals.

    In order of (begin, end, id), each item is a seed. Compared are the seed, or the extent of the cluster that
    already holds it, and every later item in reach; an item joins if, widened by buffer, the two overlap by
    min_pct of both. A seed that holds no cluster founds one only with min_size members; a partner that belongs to
    another cluster brings that cluster along.
    """
    order = np.lexsort((ids, end, beg)) if ids.dtype != object else np.array(sorted(range(len(beg)), key=lambda i: (beg[i], end[i], ids[i])))
    b, e = beg[order].astype(np.int64), end[order].astype(np.int64)
    n = len(b)
    of = np.full(n, -1)
    groups: dict[int, list[int]] = {}
    made = 0
    for i in range(n):
        own = of[i]
        lo, hi = (b[i], e[i]) if own < 0 else (b[groups[own]].min(), e[groups[own]].max())
        to = int(np.searchsorted(b, hi + 2 * buffer, side="right"))  # the items behind begin out of reach
        pb, pe = b[i + 1 : to], e[i + 1 : to]
        share = np.minimum(hi, pe) - np.maximum(lo, pb) + 2 * buffer + 1
        la, lb = hi - lo + 2 * buffer, pe - pb + 2 * buffer
        ok = (share > 0) & (lb > 0) & (la > 0)
        ok &= (share / max(la, 1) * 100 >= min_pct) & (share / np.maximum(lb, 1) * 100 >= min_pct)
        if own >= 0:
            ok &= of[i + 1 : to] != own
        got = (np.flatnonzero(ok) + i + 1).tolist()
        if not got and not (own < 0 and min_size <= 1):
            continue
        if own < 0:
            if len(got) + 1 < min_size:
                continue
            own, made = made, made + 1
            groups[own] = [i]
            of[i] = own
        for j in got:
            other = of[j]
            if other == own:
                continue
            moved = groups.pop(other) if other >= 0 else [j]
            groups[own].extend(moved)
            of[moved] = own
    out = np.full(n, -1)
    out[order] = of
    return out


def reciprocal_clusters(df: DataFrame, ref: str, beg: str, end: str, id_col: str, min_pct: float, buffer: int = 0, min_size: int = 2) -> DataFrame:
    """(id, ref, beg, end, cluster_beg, cluster_end, cluster_size) of the exact greedy sweep.

    Intervals that a gap of more than 2 * buffer separates can never meet, so every run of intervals in reach of
    each other (a block) is swept on its own; neither that nor finding the blocks brings a reference into one task. A block
    is as large as the data's depth makes it. Rows with null bounds take no part.
    """
    rows = df.where(F.col(beg).isNotNull() & F.col(end).isNotNull()).select(F.col(id_col).alias("__id"), F.col(ref).alias("__r"), F.col(beg).alias("__b"), F.col(end).alias("__e"))
    blocks = overlap_components(rows, "__r", "__b", "__e", buffer, ["__id"], "__block")

    def sweep(b, e, ids):
        k = sweep_reciprocal(b, e, ids, min_pct, buffer, min_size)
        cb, ce, n = np.zeros_like(k), np.zeros_like(k), np.zeros_like(k)
        for j in np.unique(k[k >= 0]):
            own = k == j
            cb[own], ce[own], n[own] = b[own].min(), e[own].max(), own.sum()
        return cb, ce, n

    # a block of one interval needs no sweep
    w = Window.partitionBy("__r", "__block")
    sized = blocks.withColumn("__n", F.count("*").over(w))
    many = sized.where("__n > 1").select("__r", "__block", "__id", F.col("__b").cast("bigint").alias("__b"), F.col("__e").cast("bigint").alias("__e"))
    swept = label_groups(many, ["__r", "__block"], ["__b", "__e", "__id"], ["__b", "__e", "__id"], sweep, ["cb", "ce", "n"])
    swept = swept.where("n > 0").select("__id", "__r", "__b", "__e", "cb", "ce", "n")
    if min_size <= 1:
        single = sized.where("__n = 1").select("__id", "__r", "__b", "__e", F.col("__b").alias("cb"), F.col("__e").alias("ce"), F.lit(1).cast("bigint").alias("n"))
        swept = swept.unionByName(single)
    names = dict(zip(("__id", "__r", "__b", "__e", "cb", "ce", "n"), (id_col, ref, beg, end, "cluster_beg", "cluster_end", "cluster_size")))
    return swept.select(*[F.col(k).alias(v) for k, v in names.items()])


def silhouette(x: np.ndarray, label: np.ndarray, cells: int = 1 << 22) -> float:
    """Mean silhouette of points (n, d); members of one-point clusters count 0. Distances are held for at most
    `cells` pairs at a time, or for one point."""
    ks, code, size = np.unique(label, return_inverse=True, return_counts=True)
    if len(ks) < 2:
        return -1.0
    s = np.zeros(len(x))
    step = max(1, cells // (len(x) * x.shape[1]))
    for lo in range(0, len(x), step):
        own = code[lo : lo + step]
        at = np.arange(len(own))
        d = np.sqrt(((x[lo : lo + step, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        total = np.stack([d[:, code == j].sum(axis=1) for j in range(len(ks))], axis=1)
        a = total[at, own] / np.maximum(size[own] - 1, 1)
        total = total / size
        total[at, own] = np.inf
        s[lo : lo + step] = _widths(a, total.min(axis=1), size[own])
    return float(s.mean())


def _widths(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Silhouettes from the mean distances to the own and the nearest other cluster and the own one's size."""
    top = np.maximum(a, b)
    return np.where((size > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0)


#: Rounds after which k-means gives up with an error; it ends by itself long before, as every round lowers its cost.
ROUNDS = 10_000


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's algorithm from evenly spread quantiles of the first axis: no randomness, so equal inputs agree."""
    order = np.lexsort(x.T[::-1])
    centre = x[order][np.linspace(0, len(x) - 1, k).round().astype(int)].astype(float)
    label = np.full(len(x), -1)
    for _ in range(rounds):
        new = ((x[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        if (new == label).all():
            break
        label = new
        for j in range(k):
            if (label == j).any():
                centre[j] = x[label == j].mean(axis=0)
    else:
        raise RuntimeError(f"k-means still changes after {rounds} rounds")
    return label


def line_silhouette(v: np.ndarray, count: np.ndarray, label: np.ndarray) -> float:
    """`silhouette` of points on a line, given as ascending distinct values with counts, whose clusters do not
    interleave: by prefix sums, as the nearest other cluster is a neighbour on the line."""
    first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
    if len(first) < 2:
        return -1.0
    last = np.r_[first[1:], len(v)]
    no = np.repeat(np.arange(len(first)), last - first)
    x = v - v[first][no]  # from the cluster's begin, so that the sums stay small
    n, t = np.r_[0, np.cumsum(count)], np.r_[0.0, np.cumsum(count * x)]
    size, total = n[last] - n[first], t[last] - t[first]
    mean = v[first] + total / size
    i = np.arange(len(v))
    n_left, t_left = n[i] - n[first][no], t[i] - t[first][no]
    a = (x * n_left - t_left + (total[no] - t_left) - x * (size[no] - n_left)) / np.maximum(size[no] - 1, 1)
    b = np.minimum(v - np.r_[-np.inf, mean][no], np.r_[mean, np.inf][no + 1] - v)
    return float((_widths(a, b, size[no]) * count).sum() / n[-1])


def line_kmeans(v: np.ndarray, count: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """`kmeans` of points on a line, given as ascending distinct values with counts: the label of each value."""
    n = np.cumsum(count)
    centre = v[np.searchsorted(n, np.linspace(0, n[-1] - 1, k).round().astype(int), side="right")].astype(float)
    label = np.full(len(v), -1)
    for _ in range(rounds):
        c, of = np.unique(centre, return_index=True)  # of equal centres the first one has the points
        right = np.searchsorted(c, v).clip(0, len(c) - 1)
        left = np.maximum(right - 1, 0)
        dl, dr = (v - c[left]) ** 2, (v - c[right]) ** 2
        new = np.where((dl < dr) | ((dl == dr) & (of[left] < of[right])), of[left], of[right])
        if (new == label).all():
            break
        label = new
        size, total = np.bincount(label, count, k), np.bincount(label, count * v, k)
        centre = np.where(size > 0, total / np.maximum(size, 1), centre)
    else:
        raise RuntimeError(f"k-means still changes after {rounds} rounds")
    return label


def best_kmeans(x: np.ndarray, least: float = 0.60) -> np.ndarray:
    """Labels of the k = 2, 3, ... after which the silhouette stops rising; -1 for fewer than 3 points, or where
    the best silhouette is below `least`. On one axis a round takes O(n log k) and a silhouette O(n) for n distinct
    values; on several a silhouette takes a time quadratic in the points."""
    n = len(x)
    if n < 3:
        return np.full(n, -1)
    if x.shape[1] == 1:
        v, at, count = np.unique(x[:, 0], return_inverse=True, return_counts=True)
        fit, width = (lambda k: line_kmeans(v, count, k)), (lambda label: line_silhouette(v, count, label))
    else:
        at = np.arange(n)
        fit, width = (lambda k: kmeans(x, k)), (lambda label: silhouette(x, label))
    best, score = np.full(n, -1), -2.0
    for k in range(2, n):
        label = fit(k)
        s = width(label)
        if s <= score:
            break
        best, score = label, s
    return best[at] if score >= least else np.full(n, -1)


def kmeans_clusters(df: DataFrame, keys: list[str], id_col: str, axes: list[str], least: float = 0.60) -> DataFrame:
    """(keys, id, sub_no): k-means inside each group; sub_no is -1 where a group does not split."""

    def split(*cols):
        return (best_kmeans(np.column_stack([c.astype(float) for c in cols]), least),)

    rows = df.select(*keys, id_col, *axes)
    return label_groups(rows, keys, [*axes, id_col], axes, split, ["sub_no"]).select(*keys, id_col, "sub_no")


def metaclusters(clusters: DataFrame, id_col: str, min_pct: float = 1.0, buffer: int = 200) -> DataFrame:
    """Clusters of clusters: the sweep over (ref, beg, end) of first-level clusters, singletons included."""
    return reciprocal_clusters(clusters, "ref", "beg", "end", id_col, min_pct, buffer, 1)


def component_labels(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, label): connected components of an undirected edge table (a, b), by alternating large-star and
    small-star steps; every step is one shuffle and the result of each is settled. Labels are least members. An error
    says so if the edges still change after `rounds`."""
    e = settle(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    for _ in range(rounds):
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        down = large.unionByName(e.limit(0)).where("a <> b").distinct()
        least = down.groupBy("b").agg(F.min("a").alias("m"))
        small = down.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b").alias("b")), F.struct(F.least("m", "a").alias("a"), F.greatest("m", "a").alias("b")))).alias("s"))
        new = settle(small.select("s.a", "s.b").where("a <> b").distinct())
        same = new.count() == e.count() and new.join(e, ["a", "b"], "left_anti").limit(1).count() == 0
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    label = e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))
    return nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def recluster(members: DataFrame, cluster: str, ref: str, pos: str, max_dist: int, tie: list[str], min_size: int = 1, by: list[str] | None = None) -> DataFrame:
    """Splits clusters by a second position (of the mate, of the supplementary alignment) or by further columns:
    members with sub_no, the chain of second positions on one ref within max_dist; small parts are left out."""
    keys = [cluster, ref, *(by or [])]
    parts = gap_clusters(members, keys, pos, max_dist, tie, "sub_no")
    if min_size <= 1:
        return parts
    big = parts.groupBy(*keys, "sub_no").agg(F.count("*").alias("__n")).where(F.col("__n") >= min_size).drop("__n")
    return parts.join(big, [*keys, "sub_no"], "left_semi")


def larger_side(members: DataFrame, cluster: str, ref: str, max_dist: int, tie: list[str]) -> DataFrame:
    """(cluster, side): whether a cluster's supplementary alignments gather more at their begins or at their ends
    (the largest chain decides, begins on a tie)."""
    best = None
    for pos in ("beg", "end"):
        n = recluster(members, cluster, ref, pos, max_dist, tie).groupBy(cluster, ref, "sub_no").agg(F.count("*").alias("__n"))
        top = n.groupBy(cluster).agg(F.max("__n").alias(pos))
        best = top if best is None else best.join(top, cluster)
    return best.select(cluster, F.when(F.col("end") > F.col("beg"), "end").otherwise("beg").alias("side"))


def density_labels(x: np.ndarray, reach: float, least: int) -> np.ndarray:
    """Density clusters of points (n, d): points with at least `least` points within reach, themselves included, are
    cores; cores in reach of each other share a number, others join the nearest core's or stay -1. Distances are made
    for the points near on the first axis alone, so no matrix of all pairs is held."""
    n = len(x)
    order = np.argsort(x[:, 0], kind="stable") if n else np.empty(0, dtype=int)
    line = x[order, 0] if n else np.empty(0)

    def near(i: int) -> tuple[np.ndarray, np.ndarray]:
        """Points within reach of point i, ascending, and their distances."""
        at = np.sort(order[np.searchsorted(line, x[i, 0] - reach) : np.searchsorted(line, x[i, 0] + reach, side="right")])
        d = np.sqrt(((x[at] - x[i]) ** 2).sum(axis=1))
        return at[d <= reach], d[d <= reach]

    core = np.array([len(near(i)[0]) >= least for i in range(n)], dtype=bool)
    label, no = np.full(n, -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack = [i]
        label[i] = no
        while stack:
            at = near(stack.pop())[0]
            fresh = at[core[at] & (label[at] < 0)]
            label[fresh] = no
            stack.extend(fresh.tolist())
        no += 1
    for i in np.flatnonzero(~core):
        at, d = near(i)
        if core[at].any():
            label[i] = label[at[core[at]][np.argmin(d[core[at]])]]
    return label
