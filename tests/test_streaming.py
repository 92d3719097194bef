from pyspark.sql import functions as F

from locusloom.operators.depth import read_depth
from locusloom.streaming import depth as st


def run(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, sf):
    schema = spark.read.parquet(f"{sf}/sv_events.parquet").schema
    rows = st.file_stream(spark, f"{sf}/sv_events.parquet*", schema.simpleString()[7:-1].replace(":", " "))
    return rows.where("beg is not null and end_pos >= beg").select(F.col("ref_name").alias("ref"), "beg", F.col("end_pos").alias("end"), "is_reverse", "event_id", F.col("loaded_at").cast("timestamp").alias("at"))


def test_depth_stream_equals_batch(spark, sf):
    got = run(spark, st.depth_stream(source(spark, sf), 100_000, "at", "3650 days"), "depth_s", "complete")
    batch = spark.read.parquet(f"{sf}/sv_events.parquet").where("beg is not null and end_pos >= beg").select(F.col("ref_name").alias("ref"), "beg", F.col("end_pos").alias("end"), "is_reverse")
    total = {(r.ref, r.bin): r.tdp for r in got.groupBy("ref", "bin").agg(F.sum("tdp").alias("tdp")).collect()}
    assert total == {(r.ref, r.bin): r.tdp for r in read_depth(batch, 100_000).collect()}


def test_running_bounds(spark, sf):
    got = run(spark, st.running_bounds(source(spark, sf).where("ref = 'chr1'")), "bounds_s", "update").collect()
    want = spark.read.parquet(f"{sf}/sv_events.parquet").where("ref_name = 'chr1' and beg is not null and end_pos >= beg").agg(F.count("*"), F.min("beg"), F.max("end_pos")).first()
    assert (got[-1].n, got[-1].beg, got[-1].end) == tuple(want)


def test_dedupe_and_sessions(spark, sf):
    ids = run(spark, st.dedupe_stream(source(spark, sf), "event_id", "at", "3650 days").select("event_id"), "dedupe_s", "append")
    assert ids.count() == ids.distinct().count() == spark.read.parquet(f"{sf}/sv_events.parquet").where("beg is not null and end_pos >= beg").select("event_id").distinct().count()
    n = run(spark, st.session_stream(source(spark, sf), ["ref"], "at", "30 days"), "session_s", "complete")
    assert n.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/sv_events.parquet").where("beg is not null and end_pos >= beg").count()
