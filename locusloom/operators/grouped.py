"""Loops over groups that SQL cannot express, without paying per group for a hand-over to Python.

Groups are hashed to partitions and sorted; each partition streams through as Arrow batches in which a function sees
numpy slices, one per group, and answers with integers per row. A group is held whole, so it has to be small by
nature (the hits of one query, the intervals of one block); many small ones share a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _starts(t: pa.Table, keys: int) -> np.ndarray:
    """Rows at which a new group begins."""
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for i in range(keys):
        code = t.column(i).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def label_groups(df: DataFrame, keys: list[str], order: list[str], args: list[str], fn: Callable[..., tuple[np.ndarray, ...]], outs: list[str]) -> DataFrame:
    """df with bigint columns `outs`: fn(*slices of args) of each group, its rows in `order`. Null keys form groups."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, *rest)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    at = [rows.columns.index(a) for a in args]
    schema = T.StructType(rows.schema.fields + [T.StructField(o, T.LongType()) for o in outs])
    nkeys = len(keys)

    def label(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        cols = [t.column(i).to_numpy() for i in at]
        ends = np.r_[starts[1:], t.num_rows]
        made = [fn(*(c[s:e] for c in cols)) for s, e in zip(starts, ends)]
        for i, o in enumerate(outs):
            t = t.append_column(o, pa.array(np.concatenate([m[i] for m in made]).astype(np.int64)))
        yield from t.combine_chunks().to_batches()

    def same_group(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        """Whether a's last row and b's first one belong to one group."""
        return all(a.column(i)[a.num_rows - 1].as_py() == b.column(i)[0].as_py() for i in range(nkeys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows so far of the one group that is not closed yet
        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts(pa.Table.from_batches([b]), nkeys)
            if held and not same_group(held[-1], b):
                t = pa.Table.from_batches(held)
                yield from label(t, _starts(t, nkeys))
                held = []
            if len(starts) > 1:
                t = pa.Table.from_batches([*held, b.slice(0, starts[-1])])
                yield from label(t, _starts(t, nkeys))
                held = [b.slice(starts[-1])]
            else:
                held.append(b)
        if held:
            t = pa.Table.from_batches(held)
            yield from label(t, _starts(t, nkeys))

    return rows.mapInArrow(run, schema)
