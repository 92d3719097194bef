import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from locusloom.llm.mixing import mix
from locusloom.llm.packing import bucket_bounds, pack
from locusloom.llm.ranks import with_position
from locusloom.llm.tokens import count_tokens, token_counter
from pyspark.sql import functions as F


def test_bounds_minimise_padding():
    rng = random.Random(1)
    for _ in range(20):
        sizes = np.array(sorted(rng.sample(range(1, 60), 8)))
        counts = np.array([rng.randint(1, 9) for _ in sizes])
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= s) - s) for s, c in zip(sizes, counts))
        best = min(cost([*x, sizes[-1]]) for x in itertools.combinations(sizes[:-1], 2))
        assert cost(bucket_bounds(sizes, counts, 3)) == best
    assert bucket_bounds(np.array([], dtype=int), np.array([], dtype=int)) == []


@pytest.mark.parametrize("capacity", [1, 50, 400])
def test_containers(spark, capacity):
    rng = random.Random(capacity)
    rows = [(i, rng.choice([None, 0, 1, 7, rng.randint(1, 60), rng.randint(1, 1000)])) for i in range(500)] + [(None, 9), (3, 5), (3, 5)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "id long, n long, size int, container int")
    got = pack(df, "id", "n", capacity, 6).collect()
    fill, whole = Counter(), defaultdict(list)
    for r in got:
        fill[r["container"]] += r["size"]
        whole[r["id"], r["n_pieces"]].append(r)
        assert 0 < r["size"] <= capacity and r["tok_beg"] == r["piece_no"] * capacity
    assert max(fill.values()) <= capacity and sorted(fill) == list(range(len(fill)))
    assert sum(fill.values()) == sum(n or 0 for _, n in rows)
    assert {r["id"] for r in got if r["n_pieces"] > 1} == {i for i, n in rows if n and n > capacity}
    if capacity > 1:
        assert len(fill) <= 1.06 * -(-sum(fill.values()) // capacity) + 2
    assert pack(df.limit(0), "id", "n", capacity).count() == 0


def test_positions_are_a_permutation(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 11 as string)) as g", "id", "id as position_0")
    got = with_position(df, "g", F.col("id"), ["id"], 7).collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append(r["position"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_token_counts_are_exact(spark):
    import public_tokenizers as public
    import tiktoken
    import base64

    from locusloom.llm import tokens as tk

    with open(public.path(tk.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", "a", "it's  fine\n\n\t x", "<|endoftext|>", "naïve café 123", "x" * 500, "  lead", "trail  ", "a\r\nb\x1cc\x0bd", "don't DON'T", "日本語 text", "\x00\x7f", "1234 5678"]
    count = token_counter()
    assert [count(t) if t else 0 for t in texts] == [len(enc.encode_ordinary(t)) for t in texts]
    df = spark.createDataFrame([(1, None, 5), (2, "a b", 6), (2, "a b", 6)], "id int, text string, tokens int")
    assert sorted(tuple(r) for r in count_tokens(df, "text", ["id"]).collect()) == [(1, 0), (2, 2), (2, 2)]
    assert count_tokens(df.limit(0), "text", ["id"]).count() == 0


def test_mix_reaches_targets(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([" A", "a", "A\t"]), rng.randint(1, 90)) for i in range(2000)] + [(5000 + i, "b-x", rng.randint(1, 50)) for i in range(300)]
    rows += [(9000 + i, "c", 10) for i in range(20)] + [(9500, None, 70), (9501, "zzz", 1_000_000), (9502, "b_X", None), (7, "a", 3), (7, "a", 3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, src string, n long, key int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("B_x", 0.3, 5), ("c", 0.2, 3), ("none", 0.0, 1)], "source_name string, target_share double, max_repeats int")
    used, report = mix(df, targets, "id", "src", "n")
    rep = {r["source_name"]: r for r in report.collect()}
    assert {k: v["outcome"] for k, v in rep.items()} == {"a": "cut", "B_x": "repeat", "c": "short", "none": "cut"}
    copies = Counter((r["source_name"], r["id"]) for r in used.collect())
    assert max(v for (s, i), v in copies.items() if i != 7) <= 5 and rep["B_x"]["most_copies"] <= 5 and rep["c"]["n_used"] == 60
    total = sum(n for _, s, n in rows if s and n and s != "zzz")
    assert abs(rep["a"]["actual"] - 0.5 * total) < 0.01 * total and abs(rep["B_x"]["actual"] - 0.3 * total) < 0.01 * total
    again = mix(df.repartition(9), targets, "id", "src", "n")[0]
    assert Counter((r["source_name"], r["id"]) for r in again.collect()) == copies
    none, empty = mix(df.limit(0), targets, "id", "src", "n")
    assert none.count() == 0 and {r["outcome"] for r in empty.collect()} == {"cut"}
