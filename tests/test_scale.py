"""Operators that spread one key over tasks give what a window over the key gives; found queries hang on their methods."""

import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from locusloom import session
from locusloom.operators import clustering as cl
from locusloom.operators import hotkeys, ordered
from locusloom.plans import CORE_QUERIES
from locusloom.plans.problems import PROBLEMS
from locusloom.sources import records
from locusloom.sources.records import parse_run, parse_text


def spread_rows(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        b = rng.choice([rng.randint(-50, 50), rng.randint(0, 5000), rng.randint(10**15, 10**15 + 300)])
        rows.append((rng.choice(["a", "a", "a", "b", None]), b, b + rng.choice([0, 1, 5, 40, 900, 3 * 10**14]), i))
    return rows


@pytest.mark.parametrize("seed,bits", [(1, None), (2, 0), (3, 5), (4, 40), (5, 62)])
def test_sharded_runs_equal_a_window_per_key(spark, seed, bits):
    df = spark.createDataFrame(spread_rows(seed), "ref string, beg long, end long, id int")
    w = Window.partitionBy("ref").orderBy("beg", "end", "id")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    slow = df.withColumn("s", F.when(far.isNull() | (F.col("beg") > far), 1).otherwise(0)).withColumn("no", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = {(r["id"], r["no"]) for r in slow.collect()}
    got = ordered.number_runs(df, ["ref"], "beg", ["end", "id"], F.col("end"), lambda x: x.isNull() | (F.col("__o0") > x), "no", bits)
    assert {(r["id"], r["no"]) for r in got.collect()} == want and got.columns == [*df.columns, "no"]
    assert {(r["id"], r["place"]) for r in ordered.place(df, ["ref"], "beg", ["end", "id"], bits=bits).collect()} == {(r["id"], r["n"]) for r in df.withColumn("n", F.row_number().over(w)).collect()}
    assert ordered.place(df.limit(0), ["ref"], "beg", ["id"], bits=bits).count() == 0


def test_one_hot_key_spreads_over_shards(spark):
    df = spark.range(20_000).selectExpr("'chr1' as ref", "id * 1000 as beg", "id * 1000 + 10 as end", "id")
    bits, first, last = ordered.axis_bits(df, "beg")
    assert 500 <= last - first + 1 <= 1026
    plan = ordered.place(df, ["ref"], "beg", ["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "__shard" in plan
    assert cl.gap_clusters(df, ["ref"], "beg", 999, ["id"]).agg(F.max("cluster_no")).first()[0] == 20_000
    assert cl.gap_clusters(df, ["ref"], "beg", 1000, ["id"]).agg(F.max("cluster_no")).first()[0] == 1


def slow_sweep(b, e, ids, min_pct, buffer, min_size):
    """The sweep restated one pair at a time."""
    at = sorted(range(len(b)), key=lambda i: (b[i], e[i], ids[i]))
    groups, of, made = {}, {}, 0
    for x, i in enumerate(at):
        own = of.get(i)
        lo, hi = (b[i], e[i]) if own is None else (min(b[k] for k in groups[own]), max(e[k] for k in groups[own]))
        got = []
        for j in at[x + 1 :]:
            if own is not None and of.get(j) == own:
                continue
            share = min(hi, e[j]) - max(lo, b[j]) + 2 * buffer + 1
            la, lb = hi - lo + 2 * buffer, e[j] - b[j] + 2 * buffer
            if b[j] - buffer <= hi + buffer and share > 0 and la > 0 and lb > 0 and share / la * 100 >= min_pct and share / lb * 100 >= min_pct:
                got.append(j)
        if own is None:
            if len(got) + 1 < min_size:
                continue
            own, made = made, made + 1
            groups[own], of[i] = [i], own
        for j in got:
            other = of.get(j)
            if other != own:
                for k in groups.pop(other) if other is not None else [j]:
                    groups[own].append(k)
                    of[k] = own
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("seed", range(40))
def test_sweep_against_the_restatement(seed):
    import numpy as np

    rng = random.Random(seed)
    n = rng.randint(1, 40)
    b = [rng.randint(0, 60) for _ in range(n)]
    e = [x + rng.choice([0, 1, 5, 20, 40]) for x in b]
    pct, buffer, least = rng.choice([1.0, 20.0, 80.0]), rng.choice([0, 3]), rng.choice([1, 2, 3])
    k = cl.sweep_reciprocal(np.array(b), np.array(e), np.arange(n), pct, buffer, least)
    assert {frozenset(np.flatnonzero(k == j).tolist()) for j in set(k.tolist()) - {-1}} == slow_sweep(b, e, list(range(n)), pct, buffer, least)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_lines_give_each_line_what_it_has_by_itself(seed):
    rng = random.Random(seed)
    pieces = ["chr1", "1", "5", "n", '"', '""', "Alu", "+", "\t", "\t", "\t", "\r", " ", "#", "track", "x", 'a"b', "-"]
    good = "chr1\t1\t5\tn\tAlu\t+"
    lines = [rng.choice([good, good + "\r", "", 'chr1\t1\t5\t"open\tAlu\t+', '"chr1"\t1\t5\t"a\tb"\tAlu\t.', "".join(rng.choices(pieces, k=rng.randint(0, 14)))]) for _ in range(rng.randint(1, 25))]
    want = [(i, r.get("reason"), r.get("error_off"), r.get("name")) for i, t in enumerate(lines) for r in parse_text(t, "bed", multiline=False)]
    assert [(i, row[2], row[3], row[7]) for i, row in parse_run(lines, "bed")] == want


def test_recovery_runs_in_p5(spark, sf, monkeypatch):
    """Without the search for the next record start, lines behind a broken quote are lost."""
    lines = ['chr1\t1\t5\t"open\tAlu\t+', "chr1\t1", "chr1\t1\t5\tn\tAlu\t+"]
    assert [(i, row[2]) for i, row in parse_run(lines, "bed")] == [(0, "quoting"), (1, "columns"), (2, None)]
    monkeypatch.setattr(records.RecordGrammar, "resume", lambda self, after: False)
    assert [i for i, _ in parse_run(lines, "bed")] == [0]
    text = spark.createDataFrame([(1, "bed", "f", 1, "a\nb"), (2, "bed", "f", 0, "chr1\t1\t5\tn\tAlu\t+"), (3, None, "f", 3, "x"), (4, "bed", None, None, None)], "line_id long, fmt string, file_name string, line_no int, raw_line string")
    contigs = spark.createDataFrame([("chr1", 1, None, None)], "ref_name string, ref_len long, alias_name string, accession string")
    got = records.parse_runs(text, contigs, "line_id", "fmt", "raw_line", "file_name", "line_no")
    assert {(r["line_id"], r["reason"]) for r in got.collect()} == {(1, "columns"), (2, None)}
    assert records.parse_runs(text.limit(0), contigs, "line_id", "fmt", "raw_line", "file_name", "line_no").count() == 0


def test_p4_hangs_on_its_histograms(spark, sf, monkeypatch):
    assert "Window" in PROBLEMS["p4_found"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    real = hotkeys.selected
    monkeypatch.setattr(hotkeys, "selected", lambda *a, **k: real(*a, **k).limit(0))
    assert PROBLEMS["p4_found"](spark, sf).count() == 0


def test_hot_keys_without_values(spark):
    rows = [(i, "hot", None, 1) for i in range(8)] + [(9, "b", 5, 1), (10, "c", 7, 1), (10, "c", 8, 2), (None, "d", 1, 1), (11, None, 1, 1)]
    df = spark.createDataFrame(rows, "id long, k string, v long, t int")
    run = lambda d, share: {(r["hot_key"], r["n_ids"], r["value"]) for r in hotkeys.hot_keys(d, "id", "t", F.col("k"), F.col("v"), share).collect()}
    assert run(df, 0.5) == {("hot", 8, None)} and run(df, 0.1) == {("hot", 8, None), ("b", 1, 5), ("c", 1, 8)} and run(df.limit(0), 0.1) == set()


def test_settled_tables_stay_in_a_shared_folder_and_go(spark, tmp_path):
    assert session.shared_folder("spark://x:1", "/mnt/shared") == "/mnt/shared" and session.shared_folder("local[2]", None)
    with pytest.raises(RuntimeError):
        session.shared_folder("spark://x:1", None)
    session.release_settled(spark)
    got = session.settle(spark.range(5).selectExpr("id", "struct(id as `a b`) as s", "array(id) as x"))
    folder = session._settled[-1].removeprefix("file:")
    assert got.count() == 5 and os.path.isdir(folder)
    assert session.release_settled(spark) == 1 and not os.path.exists(folder)


def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    assert session.is_small(spark.range(10)) and not session.is_small(spark.range(10), max_rows=9)
    assert not session.is_small(spark.range(10).selectExpr("repeat('x', 1000) as t"), max_bytes=5000)


def test_few_jobs_plan_a_range_join(spark, sf):
    tracker, group = spark.sparkContext.statusTracker(), "planning of q04"
    spark.sparkContext.setJobGroup(group, group)
    try:
        CORE_QUERIES["q04_overlap_join"](spark, sf)
        jobs = len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12  # of three actions: stages of an adaptive plan count as jobs of their own
