"""Percentiles with a deterministic rank error, from digests that can be added.

Values are quantized to a bounded ordered universe of 2^levels leaves. A digest counts nodes of the dyadic tree over
that universe (node 1 is the root, the children of v are 2v and 2v + 1). Compression moves a node and its sibling
into their parent where the three together hold at most n / k values; digests merge by adding the counts of equal
nodes and compressing again. The rank of any answer is off by at most levels / k of n, whatever the order, the
partitions or the number of merges; a digest of at most k values is never compressed and thus exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_checked

LEVELS = 20
COMPRESSION = 4000
#: Rows that a task digests at a time.
CHUNK = 1 << 18


def leaf_of(value: Column, low: int, high: int, levels: int = LEVELS) -> Column:
    """Leaf 0 .. 2^levels - 1 of a value in [low, high]: exact if the range has no more values than leaves."""
    width = max(1, -(-(high - low + 1) // (1 << levels)))
    return F.when(value.between(low, high), F.expr("0") + ((value - low) / F.lit(width)).cast("bigint"))


def compress(code: np.ndarray, node: np.ndarray, count: np.ndarray, limit: np.ndarray, levels: int):
    """Digests of many keys at once: (code, node, count) unique by (code, node), limit[code] = n // k."""
    done = []
    for depth in range(levels, 0, -1):
        here = node >= (1 << depth)
        if not here.any():
            continue
        c, v, k = code[here], node[here], count[here]
        up_code, up_node, up_count = code[~here], node[~here], count[~here]
        # totals of the pair and its parent
        pair = (c.astype(np.int64) << (levels + 1)) | (v >> 1)
        parents, at = np.unique(pair, return_inverse=True)
        total = np.bincount(at, weights=k, minlength=len(parents)).astype(np.int64)
        up_pair = (up_code.astype(np.int64) << (levels + 1)) | up_node
        pos = np.searchsorted(parents, up_pair)
        inside = pos < len(parents)
        match = np.zeros(len(up_pair), dtype=bool)
        match[inside] = parents[pos[inside]] == up_pair[inside]
        np.add.at(total, pos[match], up_count[match])
        fold = total <= limit[(parents >> (levels + 1))]
        keep = ~fold[at]
        done.append((c[keep], v[keep], k[keep]))
        # a folded parent takes over the pair and its own count
        taken = match.copy()
        taken[match] = fold[pos[match]]
        code = np.concatenate([up_code[~taken], (parents[fold] >> (levels + 1)).astype(up_code.dtype)])
        node = np.concatenate([up_node[~taken], parents[fold] & ((1 << (levels + 1)) - 1)])
        count = np.concatenate([up_count[~taken], total[fold]])
    done.append((code, node, count))
    return tuple(np.concatenate(x) for x in zip(*done))


def _sum_equal(code: np.ndarray, node: np.ndarray, count: np.ndarray, levels: int):
    both = (code.astype(np.int64) << (levels + 1)) | node
    u, at = np.unique(both, return_inverse=True)
    return u >> (levels + 1), u & ((1 << (levels + 1)) - 1), np.bincount(at, weights=count, minlength=len(u)).astype(np.int64)


def _encode_keys(t: pa.Table, nkeys: int):
    """(code of each row's key, one row of the key columns per code)."""
    code = np.zeros(t.num_rows, dtype=np.int64)
    for i in range(nkeys):
        enc = t.column(i).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * (len(enc.dictionary) + 1) + enc.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    _, first = np.unique(code, return_index=True)
    return code, t.select(list(range(nkeys))).take(pa.array(first))


def _digester(nkeys: int, k: int, levels: int, from_leaves: bool, whole_keys: bool):
    """Arrow function over (keys..., node or leaf, count). whole_keys: the rows come sorted by key and a key's
    digest is made of all its rows; else every chunk gives digests of its own."""

    def digest(t: pa.Table) -> pa.RecordBatch:
        code, keys = _encode_keys(t, nkeys)
        node = t.column(nkeys).to_numpy().astype(np.int64)
        count = t.column(nkeys + 1).to_numpy().astype(np.int64)
        if from_leaves:
            node = node + (1 << levels)
        code, node, count = _sum_equal(code, node, count, levels)
        limit = np.bincount(code, weights=count, minlength=keys.num_rows).astype(np.int64) // k
        code, node, count = compress(code, node, count, limit, levels)
        out = keys.take(pa.array(code)).combine_chunks()
        cols = [out.column(i).combine_chunks() if out.num_rows else pa.array([], type=out.schema.field(i).type) for i in range(nkeys)]
        cols = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols]
        return pa.RecordBatch.from_arrays([*cols, pa.array(node), pa.array(count)], names=t.schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, full = 0, CHUNK
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= full:
                t = pa.Table.from_batches(held).combine_chunks()
                cut = t.num_rows
                if whole_keys:
                    code, _ = _encode_keys(t, nkeys)
                    cut = int(np.flatnonzero(code[:-1] != code[-1])[-1]) + 1 if (code != code[-1]).any() else 0
                if cut:
                    yield digest(t.slice(0, cut))
                rest = t.slice(cut)
                held, rows = rest.to_batches(), rest.num_rows
                full = max(CHUNK, 2 * rows)  # a key beyond a chunk is looked at again only when it has doubled
        if rows:
            yield digest(pa.Table.from_batches(held))

    return run


def build(df: DataFrame, keys: list[str], leaf: str, k: int = COMPRESSION, levels: int = LEVELS) -> DataFrame:
    """Digest rows (keys..., node bigint, cnt bigint) of the leaves in column `leaf`, per key.

    Null leaves are not counted. Null keys are keys of their own. A key without leaves has no rows. Ties and
    repeated rows count as often as they occur. Other columns are not read. Empty input, empty result.
    """
    rows = df.where(F.col(leaf).isNotNull()).select(*keys, F.col(leaf).cast("bigint").alias("node"), F.lit(1).cast("bigint").alias("cnt"))
    part = rows.mapInArrow(_digester(len(keys), k, levels, True, False), rows.schema)
    return merge(part, keys, k, levels)


def merge(digests: DataFrame, keys: list[str], k: int = COMPRESSION, levels: int = LEVELS) -> DataFrame:
    """The digests added up per key and compressed again; `keys` may be fewer than those they were built for."""
    added = digests.groupBy(*keys, "node").agg(F.sum("cnt").alias("cnt"))
    parts = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = added.select(*keys, "node", "cnt").repartition(parts, *keys).sortWithinPartitions(*keys)
    return grouped.mapInArrow(_digester(len(keys), k, levels, False, True), grouped.schema)


def quantiles(digests: DataFrame, keys: list[str], pcts: list[int], low: int, width: int = 1, levels: int = LEVELS) -> DataFrame:
    """Rows (keys..., pct, n, est, at_least, at_most): for each key and pct (1..100) the value at rank
    ceil(pct * n / 100) in ascending order lies in [at_least, at_most]; est is the digest's answer, whose rank is
    off by at most levels / k of n."""
    span = F.expr(f"shiftleft(cast(1 as bigint), {levels} + 1 - length(bin(node)))")
    nodes = digests.withColumn("__w", span).withColumn("__beg", F.expr(f"node * __w - {1 << levels}")).withColumn("__end", F.expr("__beg + __w - 1"))
    by_end = Window.partitionBy(*keys).orderBy("__end", "__w").rowsBetween(Window.unboundedPreceding, 0)
    by_beg = Window.partitionBy(*keys).orderBy("__beg", "__w").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    c = nodes.select(*keys, "__beg", "__end", F.sum("cnt").over(by_end).alias("__low"), F.sum("cnt").over(by_beg).alias("__high"), F.sum("cnt").over(whole).alias("n"))
    ranks = c.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in pcts]))).withColumn("__r", F.expr("greatest(1, (pct * n + 99) div 100)"))
    out = ranks.groupBy(*keys, "pct").agg(
        F.max("n").alias("n"),
        # fewest values surely at or below __end reach the rank; most possible values at or below __beg reach it
        F.min(F.when(F.col("__low") >= F.col("__r"), F.col("__end"))).alias("__hi"),
        F.min(F.when(F.col("__high") >= F.col("__r"), F.col("__beg"))).alias("__lo"),
    )
    value = lambda e: (F.col(e) * width + F.lit(low)).cast("bigint")
    return out.select(*keys, "pct", "n", (value("__hi") + F.lit(width - 1)).alias("est"), value("__lo").alias("at_least"), (value("__hi") + F.lit(width - 1)).alias("at_most"))


def resolve(brackets: DataFrame, values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., pct, n, exact): the exact values for the brackets of `quantiles`, by counting `values` (one row
    per value) below and inside them. Brackets of one value are taken as they are; the others cost one pass."""
    done = brackets.where("at_least = at_most").select(*keys, "pct", "n", F.col("at_least").alias("exact"))
    names = [f"__q{i}" for i in range(len(keys))]
    open_ = brackets.where("at_least < at_most").select(
        *[F.col(k).alias(a) for k, a in zip(keys, names)], "pct", "n", "at_least", "at_most", F.expr("greatest(1, (pct * n + 99) div 100)").alias("__r")
    )
    same = [F.col(k).eqNullSafe(F.col(a)) for k, a in zip(keys, names)]
    hit = values.select(*keys, F.col(value).alias("__v")).join(broadcast_checked(open_), [*same, F.col("__v") <= F.col("at_most")])
    cut = F.greatest(F.col("__v"), F.col("at_least") - 1)  # everything below the bracket counts as one value
    counts = hit.groupBy(*keys, "pct", "n", "__r", cut.alias("__v")).agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys, "pct").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    found = counts.withColumn("__upto", F.sum("__c").over(w)).where("__upto >= __r").groupBy(*keys, "pct", "n").agg(F.min("__v").alias("exact"))
    return done.unionByName(found)
