"""Cutting: exact tiling, limits, overlaps and boundaries against a plain Python version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from locusloom.llm.split import PROSE, cut_pattern, interval_cuts, run_boundary, split_text


def brute_cuts(seq, step, least):
    """Greedy: the farthest position within reach that lies in or at an end of a run, else a full step."""
    good = set()
    for m in re.finditer(f"N{{{least},}}", seq):
        good |= set(range(m.start(), m.end() + 1))
    at, out = 0, []
    while len(seq) - at > step:
        best = max((p for p in range(at + 1, at + step + 1) if p in good), default=None)
        out.append((best or at + step, best is None))
        at = out[-1][0]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_sequences_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        seq = ""
        while len(seq) < rng.randint(1, 400):
            seq += "N" * rng.choice([1, 4, 5, 6, 40]) if rng.random() < 0.3 else "".join(rng.choices("ACGT", k=rng.randint(1, 60)))
        rows.append((i, seq))
    limit, overlap, least = 60, 13, 5
    df = spark.createDataFrame([(i, s, "clash") for i, s in rows], "id int, seq string, piece string")
    got = {}
    for r in split_text(df, "id", "seq", limit, overlap, (run_boundary("N", least),)).collect():
        got.setdefault(r["id"], []).append(r)
    for i, seq in rows:
        if len(seq) <= limit:
            assert i not in got
            continue
        ps = sorted(got[i], key=lambda r: r["piece_no"])
        cuts = brute_cuts(seq, limit - overlap, least)
        assert [(p["end_pos"], p["forced"]) for p in ps[:-1]] == cuts and not ps[-1]["forced"]
        assert all(p["piece"] == seq[p["beg"] : p["end_pos"]] and len(p["piece"]) <= limit for p in ps)
        assert all(b["beg"] == max(a["end_pos"] - overlap, 0) for a, b in zip(ps, ps[1:]))
        assert ps[0]["beg"] == 0 and ps[-1]["end_pos"] == len(seq)


def test_prose_prefers_strong_boundaries(spark):
    text = "one two. three four\n\nfive six seven eight nine ten eleven twelve"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "short")], "id int, text string")
    rows = split_text(df, "id", "text", 30, 4, PROSE).where("id = 1").orderBy("piece_no").collect()
    assert len(rows) == 2 * len({r["piece_no"] for r in rows})
    assert rows[0]["piece"] == "one two. three four\n\n" and not rows[0]["forced"]
    assert {r["id"] for r in split_text(df, "id", "text", 30, 4).collect()} == {1, None}
    assert split_text(df.limit(0), "id", "text", 30, 4).count() == 0


def test_unbroken_and_wide_characters(spark):
    text = "é😀" * 500
    got = split_text(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", 100, 10).orderBy("piece_no").collect()
    assert got[0]["forced"] and "".join(r["piece"][10 if i else 0 :] for i, r in enumerate(got)) == text


def test_long_text(spark):
    text = ("word " * 40_000) + "x" * 50_000
    got = split_text(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", 1000, 0).orderBy("piece_no").collect()
    assert "".join(r["piece"] for r in got) == text


def test_pattern_rejects_bad_limits(spark):
    with pytest.raises(ValueError):
        split_text(spark.createDataFrame([], "id int, text string"), "id", "text", 10, 10)
    assert cut_pattern(5, ()).count("(") == 2


@pytest.mark.parametrize("seed", range(5))
def test_intervals_like_sequences(spark, seed):
    """The position form makes the cuts that the text form makes on a text with the same gaps."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        seq = ""
        while len(seq) < 300:
            seq += "N" * rng.choice([5, 6, 40, 130]) if seq and seq[-1] != "N" else "".join(rng.choices("ACGT", k=rng.choice([1, 20, 47, 48, 90, 200])))
        gaps = [(m.start(), m.end()) for m in re.finditer("N{5,}", seq)]
        rows.append((i, len(seq), gaps or None, brute_cuts(seq, 47, 5)))
    df = spark.createDataFrame([r[:3] for r in rows], "id int, n long, gaps array<struct<gb:long,ge:long>>")
    got = {r["id"]: [tuple(c) for c in r["cuts"]] for r in df.select("id", interval_cuts(F.col("n"), F.col("gaps"), 60, 13).alias("cuts")).collect()}
    for i, _, _, want in rows:
        assert got[i] == want
