"""Texts into containers of fixed capacity.

The only thing gathered is the global histogram of sizes, which has at most `capacity` entries. On it, dynamic
programming chooses the bounds of the length buckets that minimise padding, and token-budget batches are formed
bucket by bucket, longest first: a batch takes as many items of its own bucket as the budget holds and tops the
rest up from the buckets below. The batches are a plan over sizes; each item finds its container from its size
and its position among the items of that size, so the items themselves never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .ranks import blocks_for, with_position

CAPACITY = 4096
BUCKETS = 16


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` length buckets with the least total padding (bound - size) over the
    histogram: exact dynamic programming over its distinct sizes, ascending."""
    m = len(sizes)
    if not m:
        return []
    buckets = min(buckets, m)
    n = np.r_[0, np.cumsum(counts.astype(np.int64))]
    s = np.r_[0, np.cumsum(sizes.astype(np.int64) * counts)]
    cost = np.full(m + 1, np.iinfo(np.int64).max // 4)
    cost[0] = 0
    back = np.zeros((buckets + 1, m + 1), dtype=np.int64)
    for b in range(1, buckets + 1):
        new = np.full(m + 1, np.iinfo(np.int64).max // 4)
        for j in range(b, m + 1):
            i = np.arange(b - 1, j)
            pad = cost[i] + sizes[j - 1] * (n[j] - n[i]) - (s[j] - s[i])
            at = int(np.argmin(pad))
            new[j], back[b, j] = pad[at], i[at]
        cost = new
    bounds, j = [], m
    for b in range(buckets, 0, -1):
        bounds.append(int(sizes[j - 1]))
        j = int(back[b, j])
    return bounds[::-1]


@dataclass
class Plan:
    """Runs of containers with equal content. Of the items of one size, those at positions start .. start + n - 1
    go, `per` to a container, into the containers from `first` on."""

    size: np.ndarray
    start: np.ndarray
    per: np.ndarray
    first: np.ndarray
    bucket: np.ndarray
    containers: int

    def place(self, sizes: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(container, bucket bound) of each item; runs are ordered by (size, start)."""
        key = self.size.astype(np.float64) * 2.0**40 + self.start  # exact: sizes below 2^13, positions below 2^40
        at = np.searchsorted(key, sizes.astype(np.float64) * 2.0**40 + positions, side="right") - 1
        return self.first[at] + (positions - self.start[at]) // self.per[at], self.bucket[at]


def plan_batches(sizes: np.ndarray, counts: np.ndarray, capacity: int, bounds: list[int]) -> Plan:
    """Token-budget batches over the histogram (sizes ascending, each in 1 .. capacity)."""
    left = dict(zip(sizes.tolist(), counts.tolist()))
    used = dict.fromkeys(left, 0)
    edges = [0, *bounds]
    members = [[s for s in sizes.tolist() if lo < s <= hi] for lo, hi in zip(edges, edges[1:])]
    runs: list[tuple[int, int, int, int, int]] = []
    container = 0
    for b in range(len(bounds) - 1, -1, -1):
        own = members[b]
        below = sorted((s for part in members[:b] for s in part), reverse=True)
        while own:
            while own and not left[own[-1]]:
                own.pop()
            if not own:
                break
            pattern: dict[int, int] = {}
            free = capacity
            for s in [*reversed(own), *below]:
                if not free:
                    break
                take = min(left[s], free // s)
                if take:
                    pattern[s] = take
                    free -= take * s
            repeat = min(left[s] // k for s, k in pattern.items())
            for s, k in pattern.items():
                runs.append((s, used[s], k, container, bounds[b]))
                used[s] += k * repeat
                left[s] -= k * repeat
            container += repeat
            below = [s for s in below if left[s]]
    runs.sort()
    a = np.array(runs, dtype=np.int64).reshape(-1, 5)
    return Plan(a[:, 0], a[:, 1], a[:, 2], a[:, 3], a[:, 4], container)


def pieces(tokens: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece_no, n_pieces, tok_beg, size): each text whole, or in pieces of `capacity` tokens and a rest
    where it alone exceeds a container. Null and non-positive sizes take no place and give no rows."""
    n = F.expr(f"cast(({size_col} + {capacity - 1}) div {capacity} as int)")
    rows = tokens.where(F.col(size_col) > 0).select(F.col(id_col).alias("__i"), F.col(size_col).cast("bigint").alias("__s"), n.alias("n_pieces"))
    cut = rows.select("*", F.explode(F.expr("sequence(0, n_pieces - 1)")).alias("piece_no"))
    beg = F.col("piece_no").cast("bigint") * capacity
    return cut.select(
        F.col("__i").alias(id_col), "piece_no", "n_pieces", beg.alias("tok_beg"), F.least(F.lit(capacity).cast("bigint"), F.col("__s") - beg).alias("size")
    )


def pack(tokens: DataFrame, id_col: str, size_col: str, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """(id, piece_no, n_pieces, tok_beg, size, container, bucket): the container of every piece.

    Containers are numbered from 0 and hold at most `capacity`. Only a text above the capacity is cut
    (n_pieces > 1). Texts of null or no size take no place and have no row; a null id is packed like any other;
    repeated rows are items of their own; items of equal size are interchangeable. Empty input, empty result.
    """
    if not 1 <= capacity < 1 << 13:
        raise ValueError("capacity must be from 1 to 8191")  # bounds the histogram, the plan and its broadcast
    items = settle(pieces(tokens, id_col, size_col, capacity))
    hist = sorted((r[0], r[1]) for r in items.groupBy("size").count().collect())  # at most `capacity` rows
    sizes, counts = np.array([h[0] for h in hist], dtype=np.int64), np.array([h[1] for h in hist], dtype=np.int64)
    plan = plan_batches(sizes, counts, capacity, bucket_bounds(sizes, counts, buckets))
    blocks = blocks_for(int(counts.max()) if len(counts) else 0)
    placed = with_position(items, "size", F.struct(id_col, "piece_no"), [id_col, "piece_no"], blocks)
    schema = items.withColumn("container", F.lit(0).cast("bigint")).withColumn("bucket", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns
            at, bound = plan.place(b.column(n - 2).to_numpy(), b.column(n - 1).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 1], pa.array(at), pa.array(bound)], names=[*b.schema.names[: n - 1], "container", "bucket"])

    ordered = placed.select(id_col, "piece_no", "n_pieces", "tok_beg", "size", "position")
    return ordered.mapInArrow(run, schema)
