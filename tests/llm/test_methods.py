"""The found queries hang on their methods: their plans hold them, and without them the rows are others."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.llm import areas, mixing, packing, qdigest
from locusloom.llm import queries as lq
from locusloom.llm.queries import LLM_QUERIES
from locusloom.llm.split import BLOCK, running_offsets


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_p8_reads_the_draw(spark, sf, monkeypatch):
    df = LLM_QUERIES["p8_found"](spark, sf)
    assert "Window" in plan_of(df) and "rate" in plan_of(df)
    before = {tuple(r) for r in df.collect()}
    real = mixing.draw
    monkeypatch.setattr(mixing, "draw", lambda *a, **k: real(*a, **k).withColumn("copies", F.lit(0)))
    assert {tuple(r) for r in LLM_QUERIES["p8_found"](spark, sf).collect()} != before


@pytest.mark.parametrize("seed", range(6))
def test_the_draw_shows_the_outcome_of_the_definition(spark, seed):
    rng = random.Random(seed)
    rows, targets = [], []
    for i in range(12):
        n = rng.choice([0, 1, 2, 5, 40])
        rows += [(100 * i + j, f"s{i}", rng.choice([0, 1, 10, rng.randint(1, 50)])) for j in range(n)]
        targets.append((f"s{i}", rng.choice([0.0, 0.01, 0.05, 0.2]), rng.choice([0, 1, 2, 3])))
    df = spark.createDataFrame(rows, "id long, src string, n long")
    got = {r["source_name"]: r["outcome"] for r in mixing.mix(df, spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int"), "id", "src", "n")[1].collect()}
    total = float(sum(n for _, _, n in rows))
    for name, share, cap in targets:
        size = sum(n for _, s, n in rows if s == name)
        assert got[name] == ("short" if size * cap < share * total else "repeat" if size < share * total else "cut"), (name, share, cap, size)


def test_p7_reads_the_containers(spark, sf, monkeypatch):
    df = LLM_QUERIES["p7_found"](spark, sf)
    assert "MapInArrow" in plan_of(df) and "Window" in plan_of(df)
    assert df.count() > 0
    real = packing.plan_batches

    def all_in_one(*a):
        plan = real(*a)
        plan.first[:], plan.per[:] = 0, 1 << 40
        return plan

    monkeypatch.setattr(packing, "plan_batches", all_in_one)
    with pytest.raises(Exception, match="more than its capacity"):
        LLM_QUERIES["p7_found"](spark, sf).count()


def test_p6_reads_the_digests(spark, sf, monkeypatch):
    real = qdigest.quantiles
    monkeypatch.setattr(lq.qd, "quantiles", lambda *a, **k: real(*a, **k).limit(0))
    assert LLM_QUERIES["p6_found"](spark, sf).count() == 0


def test_p6_open_brackets_are_checked(spark, sf, monkeypatch):
    """A coarse digest leaves percentiles open; the rows stay those of the fine one."""
    want = {tuple(r) for r in LLM_QUERIES["p6_found"](spark, sf).collect()}
    build, merge = qdigest.build, qdigest.merge
    monkeypatch.setattr(lq.qd, "build", lambda df, keys, leaf: build(df, keys, leaf, 40))
    monkeypatch.setattr(lq.qd, "merge", lambda df, keys, k=40, levels=20: merge(df, keys, 40, levels))
    assert {tuple(r) for r in LLM_QUERIES["p6_found"](spark, sf).collect()} == want


def test_digest_over_quantized_values(spark):
    rng = random.Random(2)
    values = [rng.randint(1, 1_000_000) for _ in range(3000)]
    levels, low, high = 12, 1, 1_000_000
    width = -(-(high - low + 1) // (1 << levels))
    df = spark.createDataFrame([("a", v) for v in values], "key string, value long").withColumn("leaf", qdigest.leaf_of(F.col("value"), low, high, levels))
    got = qdigest.quantiles(qdigest.build(df, ["key"], "leaf", 300, levels), ["key"], [10, 50, 99], low, width, levels)
    for r in got.collect():
        want = sorted(values)[-(-r["pct"] * len(values) // 100) - 1]
        assert width > 1 and r["at_least"] <= want <= r["at_most"]
        assert abs(sum(v <= r["est"] for v in values) - r["pct"] * 30) <= levels / 300 * len(values) * 2 + 3


@pytest.mark.parametrize("n", [0, 1, 2, BLOCK - 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7])
def test_running_offsets(spark, n):
    sizes = [random.Random(n + i).randint(0, 9) for i in range(n)]
    df = spark.createDataFrame([(sizes,)], "x array<bigint>")
    assert df.select(running_offsets(F.col("x"))).first()[0] == [0, *np.cumsum(sizes).tolist()]


def test_weak_labels_cover_every_document(spark):
    """Documents far beyond the bound are labelled by their addresses; the sample is spread over the areas."""
    words = {"law": ["tribunal", "statute"], "sport": ["stadium", "referee"]}
    text = lambda a, i: f"fix\n\ndiff --git a/{words[a][0]}/{words[a][1]}.py b/x\n@@ -1 +1 @@\n+filler{i} line\n"
    rows = [(i, text("law" if i % 4 else "sport", i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "__id").withColumnRenamed("text", "__text")
    y = np.array([[1, 0], [1, 0], [0, 1], [0, 1]], dtype=float)
    speaks = areas.lexicon([areas.word_features(rows[i][1], 14) for i in (1, 2, 0, 4)], y, 14)
    none = spark.createDataFrame([], "__id long")
    every = areas._weak_rows(docs, none, speaks, 2, 14, 10_000).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in every} == {0: 300, 1: 100}
    some = {r["y"]: r["count"] for r in areas._weak_rows(docs, none, speaks, 2, 14, 60).groupBy("y").count().collect()}
    assert all(10 <= some[j] <= 55 for j in (0, 1))
