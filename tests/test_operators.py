"""Operators of the interval engine against slow restatements and cases derived by hand."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusloom.conf import EngineConf
from locusloom.functions import chains, cigar, sequences, stats
from locusloom.operators import aggregates as ag
from locusloom.operators import annotation as an
from locusloom.operators import clustering as cl
from locusloom.operators import events as ev
from locusloom.operators import filters as fl
from locusloom.operators import haplotype as hp
from locusloom.operators import intervals as iv
from locusloom.operators import junctions as jn
from locusloom.operators import retro
from locusloom.operators import singlecell as sc


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


# ---- intervals


def test_overlap_conventions(spark):
    L = F.lit
    r = one(spark, a=iv.overlap_bp(L(1), L(5), L(5), L(9)), b=iv.overlap_bp(L(1), L(5), L(6), L(9)), s=iv.overlap_span(L(1), L(5), L(5), L(9)), n=iv.overlap_span(L(1), L(5), L(6), L(9)), p=iv.reciprocal_pct(L(0), L(10), L(5), L(5)), q=iv.reciprocal_pct(L(0), L(10), L(0), L(10)))
    assert (r.a, r.b, r.n) == (1, 0, None) and tuple(r.s) == (5, 5, 0)
    assert tuple(r.p) == (10.0, 0.0) and r.q.pct_a == pytest.approx(110.0)


def test_complementary(spark):
    L = F.lit
    r = one(spark, a=iv.complementary(L(100), L(200), L(10), L(90), 10, 5), b=iv.complementary(L(0), L(100), L(121), L(200), 10, 5), c=iv.complementary(L(0), L(100), L(50), L(150), 10, 20))
    assert tuple(r.a) == (True, "LEFT", 0) and r.b.ok is False and r.c.ok is False


@pytest.mark.parametrize("seed,buffer", [(1, 0), (2, 7), (3, 3000)])
def test_range_join_is_brute_force(spark, seed, buffer):
    rng = random.Random(seed)
    make = lambda n: [(i, rng.choice(["x", "y", None]), b := rng.randint(-5000, 60_000), b + rng.choice([0, 1, 5, 900, 20_000, 3_000_000, -3])) for i in range(n)]
    a, b = make(150), make(150) + [(998, "x", None, 4), (999, "x", 4, None)]
    got = iv.range_join(spark.createDataFrame(a, "i int, ref string, beg long, end long"), spark.createDataFrame(b, "j int, r_ref string, r_beg long, r_end long"), buffer)
    pairs = [(r.i, r.j) for r in got.collect()]
    want = {(i, j) for (i, r, x, y), (j, q, s, t) in itertools.product(a, b) if r and r == q and None not in (s, t) and y >= x and t >= s and x - buffer <= t and s <= y + buffer}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_bins_and_levels(spark):
    c = spark.createDataFrame([("a", 25), ("b", 10), ("c", 0)], "ref_name string, ref_len long")
    assert sorted((r.ref, r.beg, r.end) for r in iv.genomic_bins(c, 10).collect()) == [("a", 0, 10), ("a", 10, 20), ("a", 20, 25), ("b", 0, 10)]
    d = spark.createDataFrame([(1, 9_999), (9_999, 10_000), (99_999, 100_000), (999_999, 1_000_000)], "beg long, end long")
    assert [r[0] for r in d.select(iv.bin_level("beg", "end")).collect()] == [10_000, 100_000, 1_000_000, -1]
    assert d.select(iv.bin_level("beg", "end", strict=True)).collect()[3][0] is None


# ---- clusters


def slow_bin_chain(rows, size, dist):
    """Walks the bins one by one."""
    bins = {}
    for i, b, e in rows:
        if b // size == e // size:
            bins.setdefault(b // size, []).append((i, b, e))
    out, last, reach = [], None, None
    for k in sorted(bins):
        lo, hi = min(b for _, b, _ in bins[k]), max(e for _, _, e in bins[k])
        if last is not None and k == last + 1 and lo - reach <= dist:
            out[-1] |= {i for i, _, _ in bins[k]}
        else:
            out.append({i for i, _, _ in bins[k]})
        last, reach = k, hi
    return {frozenset(x) for x in out}


@pytest.mark.parametrize("seed", range(4))
def test_bin_chain(spark, seed):
    rng = random.Random(seed)
    rows = [(i, b := rng.randint(0, 900), b + rng.randint(0, 12)) for i in range(80)]
    df = spark.createDataFrame([(i, "r", b, e) for i, b, e in rows], "i int, ref string, b long, e long").repartition(5)
    got = {}
    for r in cl.bin_chain_clusters(df, "ref", "b", "e", 20, 5).collect():
        got.setdefault(r.cluster_no, set()).add(r.i)
    assert {frozenset(x) for x in got.values()} == slow_bin_chain(rows, 20, 5)


@pytest.mark.parametrize("seed,pct,buffer,least", [(1, 1, 0, 2), (2, 20, 0, 2), (3, 50, 0, 1), (4, 1, 30, 3), (5, 80, 10, 2)])
def test_reciprocal_blocks_equal_one_sweep(spark, seed, pct, buffer, least):
    rng = random.Random(seed)
    rows = [(i, b := rng.randint(0, 3000), b + rng.randint(0, 120)) for i in range(200)]
    b, e, ids = (np.array([r[k] for r in rows]) for k in (1, 2, 0))
    whole = cl.sweep_reciprocal(b, e, ids, pct, buffer, least)
    groups = {}
    for i, k in zip(ids.tolist(), whole.tolist()):
        if k >= 0:
            groups.setdefault(k, set()).add(i)
    want = {i: (min(rows[j][1] for j in g), max(rows[j][2] for j in g), len(g)) for g in groups.values() for i in g}
    df = spark.createDataFrame([(i, "r", b, e) for i, b, e in rows], "i long, ref string, b long, e long").repartition(6)
    got = {r.i: (r.cluster_beg, r.cluster_end, r.cluster_size) for r in cl.reciprocal_clusters(df, "ref", "b", "e", "i", pct, buffer, least).collect()}
    assert got == want


def test_reciprocal_edge_cases(spark):
    schema = "i long, ref string, b long, e long"
    assert cl.reciprocal_clusters(spark.createDataFrame([], schema), "ref", "b", "e", "i", 1.0).count() == 0
    df = spark.createDataFrame([(1, "r", 5, 9), (1, "r", 5, 9), (2, None, None, 3), (3, None, 1, 4)], schema)
    assert {(r.i, r.cluster_size) for r in cl.reciprocal_clusters(df, "ref", "b", "e", "i", 1.0).collect()} == {(1, 2)}


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.label for r in cl.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_that_are_not_done_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="2 rounds"):
        cl.component_labels(edges, rounds=2)


def test_kmeans_splits_two_lengths(spark):
    x = np.array([[100.0], [101], [99], [500], [505], [495]])
    label = cl.best_kmeans(x)
    assert len(set(label[:3])) == 1 and len(set(label[3:])) == 1 and label[0] != label[3]
    assert (cl.best_kmeans(x[:2]) == -1).all() and (cl.best_kmeans(np.ones((5, 1))) == -1).all()
    big = cl.best_kmeans(np.r_[np.zeros(3000), np.full(3000, 9.0)][:, None] + np.linspace(0, 0.1, 6000)[:, None])
    assert len(set(big[:3000])) == 1 and big[0] != big[-1]


@pytest.mark.parametrize("n", [40, 3000])
def test_kmeans_of_any_size_follows_the_rule_exactly(n):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(100, 5, n // 2), rng.normal(300, 40, n // 4), rng.normal(700, 30, n - n // 2 - n // 4)].round()[:, None]
    want, score = None, -2.0
    for k in range(2, n):
        label = cl.kmeans(x, k)
        d, ks = np.abs(x - x.T), np.unique(label)
        far = np.stack([d[:, label == j].sum(axis=1) for j in ks], axis=1)
        own, size = label[:, None] == ks, np.array([(label == j).sum() for j in ks])
        a = far[own] / np.maximum((own * size).sum(axis=1) - 1, 1)
        b = np.where(own, np.inf, far / size).min(axis=1)
        s = np.where((own * size).sum(axis=1) > 1, (b - a) / np.maximum(a, b), 0).mean()
        assert cl.silhouette(x, label, 5000) == pytest.approx(s)
        if s <= score:
            break
        want, score = label, s
    assert score > 0.6 and (cl.best_kmeans(x) == want).all()
    two = np.c_[x, np.zeros(n)]
    assert (cl.best_kmeans(two) == want).all()


# ---- aggregates and filters


def test_support_needs_roles(spark):
    rows = [(1, "r1", "TUMOUR"), (1, "r1", "NORMAL"), (1, "r2", "TUMOUR"), (2, "r1", None), (2, "r2", "TUMOUR")]
    got = {r.k: (r.n_reads, r.n_tumour, r.n_normal) for r in ag.support(spark.createDataFrame(rows, "k int, read_name string, role string"), ["k"]).collect()}
    assert got == {1: (2, 2, 1), 2: (2, None, None)}


def test_breakpoint_ties(spark):
    rows = [("a", p) for p in (1, 1, 9, 9, 5)] + [("b", p) for p in (3, 3, 8)] + [("c", None)]
    got = {r.k: (r.breakpoint, r.n) for r in ag.breakpoint_mode(spark.createDataFrame(rows, "k string, p long"), ["k"], "p").collect()}
    assert got == {"a": (1, 2), "b": (3, 2)}


def test_mean_position(spark):
    rows = [(1, 10), (2, 10), (2, 10), (3, 1), (3, 3), (3, 8)]
    got = {r.k: (r.mean_pos, r.ci_low, r.ci_high) for r in ag.mean_position(spark.createDataFrame(rows, "k int, p long"), ["k"], "p").collect()}
    half = 4.302652729696 * np.std([1, 3, 8], ddof=1) / np.sqrt(3)
    assert got == {1: (10, 0, 0), 2: (10, 0, 0), 3: (4, int(4 - half - 4), int(4 + half - 4))}


def test_failed_is_the_union_of_single_filters(spark):
    df = spark.createDataFrame([(1, 5, None), (9, 5, 1), (9, 50, 0)], "a int, b int, c int")
    tests = {"CV": F.col("a") < 5, "MIN-NBREADS": F.col("b") > 10, "GERMLINE": F.col("c") < 1}
    both = [r[0] for r in df.select(fl.failed(tests, fl.META)).collect()]
    single = [[n for n in fl.META if n in tests and df.select(fl.failed({n: tests[n]}, fl.META)).collect()[i][0]] for i in range(3)]
    assert both == single == [["MIN-NBREADS", "GERMLINE"], ["MIN-NBREADS", "CV", "GERMLINE"], ["CV"]]


def test_read_support_origin(spark):
    rows = [(5, 3, 2), (5, 3, 0), (5, 0, 2), (5, 0, 0), (5, None, None), (1, None, None)]
    ok, origin = fl.read_support(F.col("n"), F.col("t"), F.col("m"), 2, 1)
    got = [(r.ok, r.origin) for r in spark.createDataFrame(rows, "n long, t long, m long").select(ok.alias("ok"), origin.alias("origin")).collect()]
    assert got == [(True, "germline"), (True, "somatic-tumour"), (True, "somatic-normal"), (False, None), (True, None), (False, None)]


def test_sv_types(spark):
    rows = [(["INS"],), (["DEL", "LEFT-CLIPPING"],), (["LEFT-CLIPPING", "RIGHT-CLIPPING"],), (["RIGHT-CLIPPING"],), (["INS", "DEL"],), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "k array<string>").select(ag.sv_type(F.col("k"))).collect()]
    assert got == ["INS", "DEL", "INS_noOverlap", "BND", None, None]


# ---- reads


def test_cigar_cases(spark):
    rows = [("10S50M", 50, 50, 60, 10, 0), ("50M10H", 50, 50, 60, 0, 10), ("20M60I20M", 40, 100, 100, 0, 0), ("20M60D20M", 100, 40, 40, 0, 0), ("30M100N30M", 160, 60, 60, 0, 0), ("", 0, 0, 0, 0, 0), (None, 0, 0, 0, 0, 0), ("*", 0, 0, 0, 0, 0)]
    o = cigar.cigar_ops("c")
    got = [tuple(r) for r in spark.createDataFrame([(x[0],) for x in rows], "c string").select(cigar.ref_span(o), cigar.query_span(o), cigar.read_length(o), cigar.left_clip(o), cigar.right_clip(o)).collect()]
    assert got == [x[1:] for x in rows]


READS = "read_name string, ref string, beg long, end long, mapq int, cigar string, seq string, sa string, insert_size long, mate_ref string, mate_start long, mate_reverse boolean, is_paired boolean, is_proper boolean, is_unmapped boolean, mate_unmapped boolean, is_reverse boolean, is_dup boolean, is_supplementary boolean, is_first boolean"


def read(name, c, **kw):
    base = dict(read_name=name, ref="chr1", beg=100, end=200, mapq=60, cigar=c, seq="A", sa=None, insert_size=0, mate_ref="chr2", mate_start=5, mate_reverse=False, is_paired=True, is_proper=True, is_unmapped=False, mate_unmapped=False, is_reverse=False, is_dup=False, is_supplementary=False, is_first=True)
    return tuple((base | kw).values())


def test_event_scan(spark):
    rows = [
        read("ins", "20M60I20M"), read("del", "20M60D20M"), read("small", "20M40I20M"), read("left", "10S50M"), read("right", "50M12H"), read("both", "20S30M20S"), read("low", "20M60I20M", mapq=1),
        read("dup", "20M60I20M", is_dup=True), read("unmapped", "20M60I20M", is_unmapped=True), read("noseq", "20M60I20M", seq="*"), read("disc", "10M5I20M100N30M", is_proper=False), read("near", "9M", is_proper=False, insert_size=-20),
    ]
    df = spark.createDataFrame(rows, READS)
    conf = EngineConf(target_events=("INS", "DEL", "CLIPPING", "DISCORDANT"), min_mapq=10, read_filters=("SMS", "insertSize"))
    got = {(r.read_name, r.sv_type, r.side, r.beg, r.end, r.len) for r in ev.collect_events(df, conf).collect()}
    assert got == {
        ("ins", "INS", None, 120, 120, 60), ("del", "DEL", None, 120, 180, 60), ("left", "CLIPPING", "left", 100, 100, 10), ("right", "CLIPPING", "right", 200, 200, 12),
        ("disc", "DISCORDANT", None, 100, 135, 35), ("disc", "DISCORDANT", None, 235, 265, 30),
    }
    assert ev.count_reads(df, EngineConf(min_mapq=10)).first().n == 8


def test_supplementary_alignments(spark):
    df = spark.createDataFrame([(1, "40S60M", False, "chr2,11,+,40M60S,60,0;chr3,21,-,40S60M,30,1;", "left")], "k int, cigar string, rev boolean, sa string, side string")
    df = df.withColumn("i", ev.clipped_interval(cigar.cigar_ops("cigar"), F.col("rev"), F.col("side")))
    got = {(r.ref, r.beg, r.end, r.q_beg, r.q_end) for r in ev.supplementary_candidates(df, "k", "i", "sa").collect()}
    assert got == {("chr2", 11, 51, 0, 40), ("chr3", 21, 81, 0, 60)}


def test_flanks_and_names(spark):
    s = F.lit("ACGTACGTAC")
    r = one(spark, a=cigar.flank(s, F.lit(4), F.lit(2), "ins", 3), b=cigar.flank(s, F.lit(1), F.lit(0), "del", 3), c=cigar.flank(s, F.lit(4), F.lit(0), "left", 2), d=cigar.flank(s, F.lit(4), F.lit(0), "right", 2), n=ev.full_read_name(F.lit("r"), F.lit(1)), m=ev.full_read_name(F.lit("r"), F.lit(1), True))
    assert (r.a.seq, r.b.seq, r.c.seq, r.d.seq, r.n, r.m) == ("CGTACGTA", "ACGT", "ACGTAC", "GTACGTAC", "r/1", "r/2")


# ---- sequences and chains


def test_reverse_complement_is_an_involution(spark):
    s = F.lit("acgtnACGTN")
    r = one(spark, a=sequences.reverse_complement(s), b=sequences.reverse_complement(sequences.reverse_complement(s)))
    assert r.a == "NACGTNACGT" and r.b == "ACGTNACGTN"


def test_monomers():
    f = sequences.find_monomers
    assert f("C" * 8 + "A" * 16 + "C" * 8, "A") == [(8, 24)]
    assert f("CC" + "A" * 21 + "C", "A") == [(2, 24)]
    assert f("A" * 7, "A") == [] and f("", "A") == []
    assert f("A" * 8 + "C" * 16 + "A" * 8, "A") == [(0, 32)] and f("A" * 8 + "C" * 24 + "A" * 8, "A") == [(0, 8), (32, 40)]
    assert f("C" * 20 + "A" * 9, "A", backward=True) == [] and f("C" * 20 + "A" * 10, "A", backward=True) == [(20, 30)]


@pytest.mark.parametrize("seed", range(3))
def test_chain_in_spark_equals_plain(spark, seed):
    rng = random.Random(seed)
    rows = [(k, i, b := rng.randint(0, 400), b + rng.randint(5, 80)) for k in range(12) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "k int, i int, b long, e long")
    got = {}
    for r in chains.chain_hits(df, "k", "b", "e", ["i"], 30, 20).collect():
        got.setdefault(r.k, []).append((r.chain_no, r.i))
    for k in range(12):
        mine = sorted((b, i, e) for kk, i, b, e in rows if kk == k)
        want = [mine[x][1] for x in chains.greedy_chain([(b, e) for b, _, e in mine], 30, 20)]
        assert [i for _, i in sorted(got[k])] == want


def test_chain_by_hand():
    assert chains.greedy_chain([(0, 10), (11, 60), (61, 70), (300, 400)], 5, 10) == [3]
    assert chains.greedy_chain([(0, 10), (11, 60), (61, 70)], 5, 10) == [0, 1, 2]
    assert chains.greedy_chain([], 5, 10) == []


# ---- statistics


def test_statistics():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert stats.t_quantile(0.025, 3) == pytest.approx(-3.182446, abs=1e-5)
    assert stats.fisher_exact(8, 2, 1, 5) == pytest.approx(0.0349650, abs=1e-6)
    assert stats.fisher_exact(0, 0, 0, 0) == pytest.approx(1.0)
    a, b = np.arange(100.0), np.arange(100.0) + 60
    d, p = stats.ks_two_sample(a, b)
    assert d == pytest.approx(0.6) and p < 1e-10 and stats.ks_two_sample(a, a)[1] == 1.0


# ---- annotation, typing, junctions, haplotypes


def test_cascade_takes_the_first_stage(spark):
    e = spark.createDataFrame([(1, "r", 100, 110), (2, "r", 500, 510), (3, "r", 900, 901)], "k int, ref string, beg long, end long")
    f = lambda *rows: spark.createDataFrame(list(rows), "r_ref string, r_beg long, r_end long, label string")
    got = {r.k: (r.identity, r.stage) for r in an.cascade(e, [("a", f(("r", 105, 120, "x"), ("r", 100, 130, "y"))), ("b", f(("r", 100, 600, "z"), ("r", 505, 507, None)))], "k").collect()}
    assert got == {1: ("y", "a"), 2: ("z", "b"), 3: (None, None)}


def test_repeat_distance_rule(spark):
    e = spark.createDataFrame([(1, "r", 1000, 1000)], "k int, ref string, beg long, end long")
    rep = spark.createDataFrame([("r", 990, 1010, "A", "a"), ("r", 1050, 1100, "B", "b"), ("r", 1201, 1300, "C", "c")], "r_ref string, r_beg long, r_end long, family string, subfamily string")
    assert {(r.family, r.distance) for r in an.repeat_distances(e, rep, "k", 200).collect()} == {("A", 0), ("B", 150)}


def hit(name, strand="+", q=(0, 10), t=(0, 10), n=100):
    return (name, strand, *q, *t, n)


CHAIN = "chain array<struct<tname:string,strand:string,q_beg:long,q_end:long,t_beg:long,t_end:long,t_len:long>>"


def test_insertion_types(spark):
    c, t = "consensus|L1|x|y", "transduced|L1|22q|z"
    rows = [[hit(c)], [hit(c), hit("consensus|Alu|x|y")], [hit(t)], [hit(c), hit(t)], [hit(t), hit("transduced|L1|1p|z")], []]
    df = spark.createDataFrame([(r,) for r in rows], CHAIN).select(retro.insertion_type(F.col("chain")).alias("t"))
    assert [tuple(r.t) for r in df.collect()] == [("solo", "L1", None), ("nested", "Alu,L1", None), ("orphan", "L1", "22q"), ("partnered", "L1", "22q"), ("unknown", None, None), ("unknown", None, None)]


def test_insertion_lengths_and_strand(spark):
    rows = [[hit("consensus|L1|x|y", "-", (0, 40), (2, 50)), hit("consensus|L1|x|y", "+", (40, 90), (50, 99)), hit("transduced|L1|s|z", "+", (90, 120), (0, 400))]]
    r = spark.createDataFrame([(rows[0],)], CHAIN).select(retro.lengths(F.col("chain"), F.lit("+")).alias("l"), retro.hit_strand(F.col("chain"), F.lit(False)).alias("s"), retro.resolved_pct(F.col("chain"), F.lit(240)).alias("p")).first()
    assert tuple(r.l) == (97, True, 2, 1, 30, 40) and r.s == "+" and r.p == 50.0
    assert one(spark, m=retro.mechanism(F.lit(5), F.lit(True), F.lit(10.0))).m == "TPRT" and one(spark, m=retro.mechanism(F.lit(500), F.lit(False), F.lit(99.0))).m == "EI"


def test_virus_types(spark):
    rows = [[hit("HPV|a|d")], [hit("HPV|a|d"), hit("HPV|b|d")], [hit("HPV|a|d"), hit("HBV|b|d")], []]
    df = spark.createDataFrame([(r,) for r in rows], CHAIN).select(retro.virus_type(F.col("chain"))["ins_type"])
    assert [r[0] for r in df.collect()] == ["viralSolo", "viralFamilyNested", "viralNested", "unknown"]


def test_mobile_types(spark):
    rows = [("L1", "L1", False, False, False, False), ("L1_a_3", "L1", True, False, False, False), ("x", "y", True, True, False, False), ("g", "g", False, False, True, True), ("g", None, False, None, True, None), ("L1", None, False, None, False, None), (None,) * 6, ("L1_a_3", None, True, None, False, None), ("L1", "Alu", False, False, False, False)]
    df = spark.createDataFrame(rows, "p string, m string, pt boolean, mt boolean, pg boolean, mg boolean").select(retro.mobile_type(*[F.col(c) for c in ("p", "m", "pt", "mt", "pg", "mg")]))
    assert [r[0] for r in df.collect()] == ["TD0", "TD1", "TD2", "PSD", "RG", "TD0-TD1", None, "UNRESOLVED-TD", "UNDEFINED"]


def test_junctions_once_per_pair(spark):
    p = spark.createDataFrame([("a", "r2", 500, 510, 4, 50.0, "r1", 1), ("b", "r1", 90, 100, 3, 60.0, "r2", 505), ("a", "r2", 500, 510, 1, 90.0, "r1", 1)], "meta string, ref string, beg long, end long, n_reads long, pct double, m_ref string, m_pos long")
    c = spark.createDataFrame([("b", "r2", 505, 505), ("a", "r1", 95, 96)], "r_meta string, r_ref string, r_beg long, r_end long")
    assert [tuple(r) for r in jn.junctions(p, c, 2, 10).select("meta_a", "meta_b", "n_reads", "pct", "type").collect()] == [("a", "b", 4, 60.0, "interchromosomal")]


def test_own_junctions_are_junctions_of_clusters_with_themselves(spark):
    rng = random.Random(5)
    rows = [(f"c{i}", rng.choice(["r1", "r2", None]), b := rng.choice([rng.randrange(3000), rng.randrange(5), None]), None if b is None else b + rng.choice([0, 1, 40, 900, 70_000, -3]), rng.choice([1, 2, 5, None]), rng.choice([5.0, 20.0, 90.0])) for i in range(300)]
    c = spark.createDataFrame(rows, "meta string, ref string, beg long, end long, n_reads long, pct double")
    other = c.select(F.col("meta").alias("r_meta"), F.col("ref").alias("r_ref"), F.col("beg").alias("r_beg"), F.col("end").alias("r_end"))
    names = ["meta_a", "meta_b", "n_reads", "pct", "type"]
    for buffer in (0, 100, 20_000):
        want = jn.junctions(c.withColumn("m_ref", F.col("ref")).withColumn("m_pos", F.col("beg")), other, 2, 10.0, buffer).select(names).collect()
        assert want and sorted(map(tuple, jn.own_junctions(c, 2, 10.0, buffer).select(names).collect())) == sorted(map(tuple, want))


def test_junctions_of_clippings_move_no_pairs(spark, sf):
    from locusloom.plans import CORE_QUERIES

    plan = CORE_QUERIES["q73_junctions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan


def test_haplotype_codes(spark):
    df = spark.createDataFrame([("A", "C"), ("T", "G"), ("A", "A"), ("AC", "A"), ("A", "ACG")], "r string, a string")
    got = [(x[0], x[1]) for x in df.select(hp.snp_code(F.col("r"), F.col("a")), hp.indel_code(F.col("r"), F.col("a"))).collect()]
    assert got == [(1, None), (12, None), (None, None), (None, "-AC"), (None, "+ACG")]


def test_breakage_fusion_bridge(spark):
    rows = [(1, "c", "r", 100, 200, "del"), (2, "c", "r", 300, 400, "dup"), (3, "c", "r", 500, 600, "idup"), (4, "c", "r", 90_000_000, 90_000_100, "dup"), (5, "d", "r", 100, 200, "del"), (6, "d", "r", 300, 400, "inv")]
    df = spark.createDataFrame(rows, "event_id int, cell_id string, ref string, beg long, end long, sv_class string").withColumn("ref_len", F.lit(100_000_000))
    assert [(r.cell_id, r.n_run, r.n_dup) for r in sc.breakage_fusion_bridge(df, "p").collect()] == [("c", 2, 2)]


def test_grouped_labels_cross_batches(spark):
    from locusloom.operators.grouped import label_groups

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame([(k, i) for k in ["a", "b", None, "c"] for i in range(10)], "k string, i long")
        got = label_groups(df, ["k"], ["i"], ["i"], lambda i: (np.full(len(i), i.sum()),), ["s"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 40 and {r.s for r in got} == {45}


def test_kmer_alignment_finds_both_strands(spark):
    from locusloom.operators.aligner import kmer_align, preset

    rng = random.Random(8)
    t = "".join(rng.choices("ACGT", k=400))
    q = t[100:200]
    rev = q[::-1].translate(str.maketrans("ACGT", "TGCA"))
    qs = spark.createDataFrame([("f", q), ("r", rev), ("none", "ACGT" * 2), ("null", None), ("empty", "")], "seq_id string, seq string")
    got = {(h.q_name, h.strand): (h.q_beg, h.q_end, h.t_beg, h.t_end, h.matches) for h in kmer_align(qs, spark.createDataFrame([("t", t)], "seq_id string, seq string")).collect()}
    assert got == {("f", "+"): (0, 100, 100, 200, 90), ("r", "-"): (0, 100, 100, 200, 90)}
    assert preset("HIFI") == "map-hifi"
    with pytest.raises(ValueError):
        preset("X")


def aligned_slowly(queries, targets, k, band, least):
    """kmer_align pair by pair and letter by letter; rows of one id and length count as one sequence."""
    cells, out = {}, []
    for (qi, q), strand, (ti, t) in itertools.product([x for x in queries if x[1]], "+-", [x for x in targets if x[1]]):
        q, t = (x.upper() for x in (q, t))
        if strand == "-":
            q = q[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for p, r in itertools.product(range(len(q) - k + 1), range(len(t) - k + 1)):
            if q[p : p + k] == t[r : r + k] and not set(q[p : p + k]) - set("ACGT"):
                cells.setdefault((qi, len(q), strand, ti, len(t)), {}).setdefault((r - p) // band, set()).add((p, r))
    for (qi, qn, strand, ti, tn), bands in cells.items():
        runs = []
        for d in sorted(bands):
            runs = [*runs[:-1], [*runs[-1], d]] if runs and d - runs[-1][-1] == 1 else [*runs, [d]]
        for run in runs:
            n, (ps, rs) = sum(len({p for p, _ in bands[d]}) for d in run), zip(*(x for d in run for x in bands[d]))
            if n >= least:
                q0, q1 = min(ps), max(ps) + k
                out.append((qi, qn, qn - q1 if strand == "-" else q0, qn - q0 if strand == "-" else q1, strand, ti, tn, min(rs), max(rs) + k, n, q1 - q0, 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("k", [4, 11, 16, 21])
def test_kmer_alignment_of_blocks_against_brute_force(spark, monkeypatch, k):
    from locusloom.operators import aligner

    rng = random.Random(k)
    base = "".join(rng.choices("ACGT", k=90))

    def piece():
        s = base[rng.randrange(60) :][: rng.randrange(5, 60)]
        s = s[::-1].translate(str.maketrans("ACGT", "TGCA")) if rng.random() < 0.4 else s
        return rng.choice(["", "N", "A" * 25, "é"]) + (s.lower() if rng.random() < 0.3 else s)

    a = [(f"q{i}", piece() + piece()) for i in range(9)]
    a += [("q1", a[1][1]), ("q1", a[1][1][::-1]), (None, base), (None, base), ("x\ty", base[10:60]), ("null", None), ("empty", "")]
    b = [(f"t{i}", piece() + piece()) for i in range(5)] + [("t", base)]
    qs, ts = (spark.createDataFrame(x, "seq_id string, seq string") for x in (a, b))
    monkeypatch.setattr(aligner, "BLOCK", 200)  # several blocks
    assert aligner.blocks(qs, k).count() > 1
    for targets, rows in ((qs, a), (ts, b)):
        want = aligned_slowly(a, rows, k, 16, 3)
        assert want and sorted(map(tuple, aligner.kmer_align(qs, targets, k).collect()), key=str) == want


def test_steps_of_hits_count_every_begin_once(monkeypatch):
    from locusloom.operators import aligner

    rng = random.Random(3)
    rows = [(f"s{i}", "".join(rng.choices("ACGT", k=30)) + rng.choice(["A" * 40, "AC" * 20, ""])) for i in range(6)]
    monkeypatch.setattr(aligner, "STEP", 9)  # below the hits of a repeated k-mer
    one, two = (aligner._pack(i, x) for i, x in enumerate((rows[:3], rows[3:])))
    pairs = aligner.pa.RecordBatch.from_arrays(one.columns + two.columns, [str(i) for i in range(10)])
    got = [tuple(r.values()) for b in aligner._aligner(11, 16, 3, True)(iter([pairs])) for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted(aligned_slowly(rows[:3], rows[3:], 11, 16, 3) + aligned_slowly(rows[3:], rows[:3], 11, 16, 3), key=str)


def test_kmer_alignment_moves_no_kmers(spark, sf):
    from locusloom.plans import CORE_QUERIES

    plan = CORE_QUERIES["q82_kmer_alignment"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not any(x in plan for x in ("Generate", "Aggregate", "hashpartitioning"))


@pytest.mark.parametrize("seed", range(2))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.label for r in cl.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
