"""Streams of alignments and events: depth per bin, and per-key summaries in session windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """Arriving files of a folder as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def depth_stream(reads: DataFrame, size: int, time: str, delay: str = "1 day", span: str = "1 day") -> DataFrame:
    """Reads per (window of arrival, ref, bin), in all and by strand; later than `delay` is late data and ignored."""
    hit = reads.withWatermark(time, delay).select(time, "ref", "is_reverse", F.explode(F.expr(f"sequence(beg div {size}, end div {size})")).alias("bin"))
    return hit.groupBy(F.window(time, span), "ref", "bin").agg(F.count("*").alias("tdp"), F.count_if(~F.col("is_reverse")).alias("wdp"), F.count_if(F.col("is_reverse")).alias("cdp"))


def session_stream(events: DataFrame, keys: list[str], time: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Events per key and session: a session ends after `gap` without one."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def dedupe_stream(events: DataFrame, id_col: str, time: str, delay: str = "1 day") -> DataFrame:
    """Events without re-deliveries; ids are remembered as long as the watermark allows."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([id_col])


def running_bounds(events: DataFrame, key: str = "ref") -> DataFrame:
    """Per key the count and bounds of all events so far, kept as state across batches: (key, n, beg, end)."""

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, lo, hi = state.get if state.exists else (0, None, None)
        for f in frames:
            f = f.dropna(subset=["beg", "end"])
            if len(f):
                n += len(f)
                lo = int(f["beg"].min()) if lo is None else min(lo, int(f["beg"].min()))
                hi = int(f["end"].max()) if hi is None else max(hi, int(f["end"].max()))
        state.update((n, lo, hi))
        yield pd.DataFrame({key: [k[0]], "n": [n], "beg": [lo], "end": [hi]})

    kind = dict(events.dtypes)[key]
    return events.select(key, "beg", "end").groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n bigint, beg bigint, end bigint", "n bigint, beg bigint, end bigint", "update", "NoTimeout")
