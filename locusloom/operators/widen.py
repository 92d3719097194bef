"""Attribute-value rows into one typed row per entity.

The newest usable statement of each (entity, attribute) is picked by a combining aggregate, so restated or hot
entities shrink before the shuffle. Entities are then hash-bucketed; each bucket, sorted by entity, streams
through Arrow batches in which entity and attribute are dictionary-encoded and the values scattered into one
numpy array per column type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.contigs import squeeze

#: Values that state nothing, compared without regard to case.
PLACEHOLDERS = ("", ".", "NA", "N/A", "NONE", "NULL", "NAN")
INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPARK = {"String": T.StringType(), "Integer": T.LongType(), "Float": T.DoubleType(), "Flag": T.IntegerType()}
_ARROW = {"String": pa.string(), "Integer": pa.int64(), "Float": pa.float64(), "Flag": pa.int32()}
_NUMPY = {"String": object, "Integer": np.int64, "Float": np.float64, "Flag": np.int32}


def _typed(value, kind):
    """The value as canonical text if it is usable for its type, else null."""
    v = squeeze(value)
    plain = F.when(~F.upper(v).isin(*PLACEHOLDERS), v)
    return (
        F.when(kind == "String", plain)
        .when(kind == "Integer", F.when(v.rlike(INTEGER), v.try_cast("bigint").cast("string")))
        .when(kind == "Float", F.when(v.rlike(FLOAT), v))
        .when(kind == "Flag", F.when(F.lower(v).isin("false", "0"), "0").otherwise("1"))
    )


def _scatter(columns: list[tuple[str, str]], defaults: dict[str, object], entity: str):
    names = [n for n, _ in columns]
    kinds = {t: [n for n, k in columns if k == t] for t in _SPARK}
    schema = pa.schema([(entity, pa.int64())] + [(n, _ARROW[t]) for n, t in columns])

    def emit(ids: np.ndarray, attrs: pa.Array, values: pa.Array) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        row = np.cumsum(np.r_[True, ids[1:] != ids[:-1]]) - 1
        enc = attrs.dictionary_encode()
        words = enc.dictionary.to_pylist()
        code = enc.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        n = len(first)
        made = {}
        for kind, cols in kinds.items():
            if not cols:
                continue
            grid = np.empty((n, len(cols)), dtype=_NUMPY[kind])
            seen = np.zeros((n, len(cols)), dtype=bool)
            slot = {c: j for j, c in enumerate(cols)}
            to_col = np.array([slot.get(w, -1) for w in words] + [-1], dtype=np.int64)
            col = to_col[code]
            at = np.flatnonzero(col >= 0)
            got = values.take(pa.array(at))
            if kind == "String":
                grid[row[at], col[at]] = np.array(got.to_pylist(), dtype=object)
            else:
                grid[row[at], col[at]] = got.cast(_ARROW[kind]).to_numpy(zero_copy_only=False)
            seen[row[at], col[at]] = True
            for c, j in slot.items():
                mask = ~seen[:, j]
                if c in defaults:
                    grid[mask, j] = defaults[c]
                    made[c] = pa.array(grid[:, j], type=_ARROW[kind])
                else:
                    made[c] = pa.array(grid[:, j], type=_ARROW[kind], mask=mask)
        return pa.RecordBatch.from_arrays([pa.array(ids[first])] + [made[c] for c in names], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # rows of the entity that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            t = t.combine_chunks()
            ids = t.column(0).to_numpy()
            cut = int(np.searchsorted(ids, ids[-1], side="left"))
            held = t.slice(cut)
            if cut:
                head = t.slice(0, cut).combine_chunks()
                yield emit(ids[:cut], head.column(1).chunk(0), head.column(2).chunk(0))
        if held is not None and held.num_rows:
            held = held.combine_chunks()
            yield emit(held.column(0).to_numpy(), held.column(1).chunk(0), held.column(2).chunk(0))

    return run


def widen(
    df: DataFrame,
    columns: list[tuple[str, str]],
    entity: str = "variant_id",
    attr: str = "attr_name",
    value: str = "attr_value",
    order: tuple[str, ...] = ("loaded_at", "row_no"),
    defaults: dict[str, object] | None = None,
) -> DataFrame:
    """One row per non-null entity with a typed column for each (name, type) of `columns`.

    Types are String, Integer, Float and Flag. Names compare without case and surrounding white space, as do the
    placeholder values. Of several usable statements the one latest in `order` counts (null orders first; of
    rows equal in all of it, the greatest value). What is stated nowhere, or nowhere usably, is null, or
    `defaults[name]`. An integer beyond 64 bits is not usable. A flag is set by any row, valued or not, but for
    `false` and `0`. Entities whose rows are all unusable still get their row; rows with a null entity are
    ignored; further columns are not read; an empty input gives an empty result.
    """
    kinds = {n.upper(): t for n, t in columns}
    lookup = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]) if kinds else F.lit(None)
    name = F.upper(squeeze(F.col(attr)))
    rows = (
        df.where(F.col(entity).isNotNull())
        .select(F.col(entity).cast("bigint").alias("__e"), name.alias("__a"), F.col(value).cast("string").alias("__v"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
        .withColumn("__t", F.try_element_at(lookup, F.col("__a")))
        .withColumn("__v", _typed(F.col("__v"), F.col("__t")))
        # what cannot be used only says that the entity exists
        .withColumn("__a", F.when(F.col("__v").isNotNull(), F.col("__a")))
    )
    newest = rows.groupBy("__e", "__a").agg(F.max(F.struct(*[f"__o{i}" for i in range(len(order))], "__v")).alias("__m"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = newest.select("__e", "__a", F.col("__m.__v").alias("__v")).repartition(parts, "__e").sortWithinPartitions("__e")
    schema = T.StructType([T.StructField(entity, T.LongType())] + [T.StructField(n.upper(), _SPARK[t]) for n, t in columns])
    run = _scatter([(n.upper(), t) for n, t in columns], {k.upper(): v for k, v in (defaults or {}).items()}, entity)
    return buckets.mapInArrow(run, schema)


def other_attributes(
    df: DataFrame,
    columns: list[tuple[str, str]],
    entity: str = "variant_id",
    attr: str = "attr_name",
    value: str = "attr_value",
    order: tuple[str, ...] = ("loaded_at", "row_no"),
    out: str = "others",
) -> DataFrame:
    """(entity, out): what `widen` with the same `columns` has no column for, an array of (name, value) in order of
    the name, for each entity that states such an attribute usably.

    The names are upper-case; having no declared type, the values are usable as strings are, and the newest usable
    one counts as in `widen`. Rows without a name state no attribute.
    """
    name = F.upper(squeeze(F.col(attr)))
    declared = [n.upper() for n, _ in columns]
    rows = (
        df.select(F.col(entity).cast("bigint").alias(entity), name.alias("__a"), _typed(F.col(value).cast("string"), F.lit("String")).alias("__v"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)])
        .where(F.col(entity).isNotNull() & F.col("__v").isNotNull() & (F.col("__a") != ""))
        .where(~F.col("__a").isin(*declared))
    )
    newest = rows.groupBy(entity, "__a").agg(F.max(F.struct(*[f"__o{i}" for i in range(len(order))], "__v")).alias("__m"))
    return newest.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(F.col("__a").alias("name"), F.col("__m.__v").alias("value")))).alias(out))
