import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusloom.llm import qdigest as qd


def exact(values, pct):
    return sorted(values)[max(1, -(-pct * len(values) // 100)) - 1]


@pytest.mark.parametrize("k,levels", [(50, 10), (400, 10), (10_000, 20)])
def test_bounded_rank_error(spark, k, levels):
    rng = random.Random(k)
    top = 1 << levels
    rows = []
    for i in range(6000):
        key = rng.choice(["a"] * 6 + ["b", None])
        v = rng.choice([0, top - 1, int(abs(rng.gauss(0, top / 5))) % top, rng.randrange(top), None])
        rows.append((i % 3, key, v))
    df = spark.createDataFrame([(*r, 1) for r in rows], "batch int, key string, leaf long, node int").repartition(5)
    parts = qd.build(df, ["batch", "key"], "leaf", k, levels)
    whole = qd.merge(parts, ["key"], k, levels)
    by = defaultdict(list)
    for _, key, v in rows:
        if v is not None:
            by[key].append(v)
    pcts = [1, 25, 50, 90, 100]
    got = qd.quantiles(whole, ["key"], pcts, 0, 1, levels)
    seen = 0
    for r in got.collect():
        vals = by[r["key"]]
        want = exact(vals, r["pct"])
        rank = max(1, -(-r["pct"] * len(vals) // 100))
        assert r["n"] == len(vals) and r["at_least"] <= want <= r["at_most"]
        below, upto = sum(v < r["est"] for v in vals), sum(v <= r["est"] for v in vals)
        error = max(0, below + 1 - rank, rank - upto)
        assert error <= levels / k * len(vals) * 2 + 1
        if k > len(vals):
            assert r["at_least"] == r["at_most"] == want
        seen += 1
    assert seen == len(by) * len(pcts)
    res = qd.resolve(got, df.where("leaf is not null").withColumn("value", F.col("leaf")), ["key"], "value")
    assert {(r["key"], r["pct"]): r["exact"] for r in res.collect()} == {(key, p): exact(v, p) for key, v in by.items() for p in pcts}
    nodes = whole.groupBy("key").count().collect()
    assert all(r["count"] <= 3 * k + 1 for r in nodes)


def test_empty_and_single(spark):
    schema = "key string, leaf long"
    assert qd.build(spark.createDataFrame([], schema), ["key"], "leaf").count() == 0
    one = qd.build(spark.createDataFrame([("a", 7), ("a", 7), ("b", None)], schema), ["key"], "leaf")
    got = qd.quantiles(one, ["key"], [50], 1).collect()
    assert [(r["key"], r["est"], r["n"]) for r in got] == [("a", 8, 2)]


def test_leaves_cover_wide_ranges(spark):
    v = qd.leaf_of(F.col("id"), 0, 1 << 22, 20)
    rows = spark.createDataFrame([(0,), (1 << 22,), (5,), (-1,), (None,)], "id long").select("id", v.alias("leaf")).collect()
    assert {r["id"]: r["leaf"] for r in rows} == {0: 0, 1 << 22: (1 << 22) // 5, 5: 1, -1: None, None: None}
