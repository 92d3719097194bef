"""Whole queries that SQL cannot state, against slow restatements over the same tables."""

import statistics
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_scale import slow_sweep

from locusloom.functions.stats import ks_two_sample
from locusloom.plans import CORE_QUERIES
from locusloom.plans import tables as tb


@pytest.fixture(scope="module")
def events(spark, sf):
    return [r.asDict() for r in tb.events(spark, sf).collect()]


def sweep(rows, pct, buffer, least):
    """Clusters (lists of rows) of the sweep, reference by reference, without blocks."""
    by = defaultdict(list)
    for r in rows:
        by[r["ref"]].append(r)
    out = []
    for v in by.values():
        for g in slow_sweep([r["beg"] for r in v], [r["end"] for r in v], [r["id"] for r in v], pct, buffer, least):
            out.append([v[i] for i in g])
    return out


def chained(rows, size, reach, least=1):
    """Bin-chain clusters, bin by bin."""
    bins = defaultdict(list)
    for r in rows:
        if r["beg"] // size == r["end"] // size:
            bins[r["ref"], r["beg"] // size].append(r)
    out, last = [], None
    for (ref, b), v in sorted(bins.items()):
        if last and last[0] == ref and b - last[1] == 1 and min(r["beg"] for r in v) - last[2] <= reach:
            out[-1].extend(v)
        else:
            out.append(list(v))
        last = (ref, b, max(r["end"] for r in v))
    return [c for c in out if len(c) >= least]


def extent(c):
    return c[0]["ref"], min(r["beg"] for r in c), max(r["end"] for r in c)


def test_q47(spark, sf, events):
    rows = [r | {"id": r["event_id"]} for r in events if r["sv_type"] == "DEL"]
    want = {(r["event_id"], *extent(c), len(c)) for c in sweep(rows, 20.0, 0, 2) for r in c}
    got = {(r["event_id"], r["ref"], r["cluster_beg"], r["cluster_end"], r["cluster_size"]) for r in CORE_QUERIES["q47_exact_reciprocal"](spark, sf).collect()}
    assert got == want and want


def test_q75(spark, sf, events):
    k = [dict(zip(("ref", "beg", "end"), extent(c))) for c in chained([r for r in events if r["sv_type"] == "INS"], 1000, 200)]
    rows = [r | {"id": i} for i, r in enumerate(sorted(k, key=lambda r: (r["ref"], r["beg"])))]
    want = Counter((*extent(m), len(m)) for m in sweep(rows, 1.0, 200, 1))
    assert Counter(tuple(r) for r in CORE_QUERIES["q75_metaclusters"](spark, sf).collect()) == want


def line_clusters(x):
    """Lloyd and silhouette point by point; the labels' partition, or None where the group does not split."""
    n = len(x)
    if n < 3:
        return None
    best, score = None, -2.0
    for k in range(2, n):
        xs = sorted(x)
        centre = [float(xs[int(round(i))]) for i in np.linspace(0, n - 1, k)]
        label = None
        while True:
            new = [min(range(k), key=lambda j: ((v - centre[j]) ** 2, j)) for v in x]
            if new == label:
                break
            label = new
            centre = [statistics.fmean([v for v, m in zip(x, label) if m == j]) if j in label else centre[j] for j in range(k)]
        groups = {j: [v for v, m in zip(x, label) if m == j] for j in set(label)}
        s = -1.0
        if len(groups) > 1:
            widths = []
            for v, m in zip(x, label):
                if len(groups[m]) == 1:
                    widths.append(0.0)
                    continue
                a = sum(abs(v - u) for u in groups[m]) / (len(groups[m]) - 1)
                b = min(sum(abs(v - u) for u in g) / len(g) for j, g in groups.items() if j != m)
                widths.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
            s = sum(widths) / n
        if s <= score + 1e-12:
            break
        best, score = label, s
    return best if score >= 0.60 else None


def test_q50(spark, sf, events):
    got = defaultdict(dict)
    for r in CORE_QUERIES["q50_kmeans"](spark, sf).collect():
        got[r["ref"], r["cluster_no"]][r["event_id"]] = r["sub_no"]
    found = {frozenset(g): g for g in got.values()}
    seen = 0
    for c in chained([r for r in events if r["sv_type"] == "INS"], 1000, 200):
        x = [r["len"] for r in c]
        mean = statistics.fmean(x)
        if not mean or statistics.pstdev(x) * 100 / mean <= 15:
            continue
        seen += 1
        mine = found[frozenset(r["event_id"] for r in c)]
        want = line_clusters(x)
        if want is None:
            assert set(mine.values()) == {-1}
        else:
            assert len({(mine[r["event_id"]], m) for r, m in zip(c, want)}) == len(set(want)) == len(set(mine.values()))
    assert seen == len(found) > 5


def test_q59(spark, sf):
    by = defaultdict(list)
    for r in tb.cell_svs(spark, sf).collect():
        by[r["cell_id"], r["ref"]].append((r["beg"], r["end"]))
    got = {(r["cell_id"], r["ref"]): (r["n_sv"], r["p"], r["score"]) for r in CORE_QUERIES["q59_spacing_test"](spark, sf).collect()}
    assert set(got) == set(by)
    for key, v in by.items():
        v.sort()
        n, p, score = len(v), 1.0, 0.0
        if n >= 5:
            gaps = np.array([float(b[0] - a[1]) for a, b in zip(v, v[1:])])
            rng = np.random.default_rng([7, *[zlib.crc32(str(k).encode()) for k in key]])
            free = max(1.0, float(tb.CELL_LENGTH) - sum(e - b for b, e in v))
            rand = np.concatenate([np.diff(np.sort(rng.uniform(0, free, n))) for _ in range(20)])
            p = ks_two_sample(gaps, rand)[1]
            m, r = float(np.median(gaps)), float(np.median(rand))
            score = float(-np.log2(m / r)) if m > 0 and r > 0 else 0.0
        assert got[key][0] == n and got[key][1:] == pytest.approx((p, score), abs=2e-6)


def reads(rows, role=None):
    return len({r["read_name"] for r in rows if r["read_name"] is not None}) if role is None else len({r["read_name"] for r in rows if r["role"] == role})


def support(rows):
    unknown = any(r["role"] is None for r in rows)
    return reads(rows), None if unknown else reads(rows, "TUMOUR"), None if unknown else reads(rows, "NORMAL")


def test_q76(spark, sf, events):
    """The long-read pipeline from events to judged metaclusters, in plain loops."""
    f = [r.asDict() for r in tb.features(spark, sf).collect()]
    near = defaultdict(list)
    for r in f:
        near[r["r_ref"]].append((r["r_beg"], r["r_end"]))
    of = lambda kind: [r | {"id": r["event_id"]} for r in events if r["sv_type"] == kind]
    clusters = chained(of("INS"), 200, 200, 2) + chained(of("CLIPPING"), 50, 50, 2) + sweep(of("DEL"), 20.0, 0, 2)
    firsts = []
    for c in clusters:
        kind = c[0]["sv_type"]
        ref, beg, end = extent(c)
        firsts.append({"ref": ref, "beg": beg, "end": end, "id": f"{kind}:{ref}:{beg:012d}", "c": c})
    # ids of the library differ, but order ties only between clusters of equal extent
    want = Counter()
    for m in sweep(firsts, 1.0, 200, 1):
        rows = [r for k in m for r in k["c"]]
        ref, beg, end = extent(rows)
        n, t, nn = support(rows)
        kinds = {("LEFT-" if r["is_reverse"] else "RIGHT-") + "CLIPPING" if r["sv_type"] == "CLIPPING" else r["sv_type"] for r in rows if not (r["sv_type"] == "CLIPPING" and r["is_reverse"] is None)}
        if {"INS", "DEL"} <= kinds:
            sv = None
        elif kinds & {"INS", "DEL"}:
            sv = next(iter(kinds & {"INS", "DEL"}))
        else:
            sv = "INS_noOverlap" if len(kinds & {"LEFT-CLIPPING", "RIGHT-CLIPPING"}) == 2 else "BND" if kinds & {"LEFT-CLIPPING", "RIGHT-CLIPPING"} else None
        sizes = [r["len"] for r in rows if r["sv_type"] == "INS"]
        cv = statistics.pstdev(sizes) * 100 / statistics.fmean(sizes) if sizes and statistics.fmean(sizes) else 0.0
        known = t is not None
        ok = (t >= 2 or nn >= 1) if known else n >= 2
        origin = ("germline" if t >= 2 and nn >= 1 else "somatic-tumour" if t >= 2 else "somatic-normal" if nn >= 1 else None) if known else None
        bad = [x for x, holds in (("MIN-NBREADS", ok), ("MAX-NBREADS", len(rows) <= 500), ("CV", cv <= 30), ("SV-TYPE", sv in ("INS", "DEL"))) if not holds]
        repeats = sum(b <= end + 200 and e >= beg - 200 for b, e in near[ref])
        want[(ref, beg, end, sv, len(rows), n, t, nn, origin, ",".join(bad), repeats)] += 1
    got = CORE_QUERIES["q76_long_read_calls"](spark, sf).collect()
    assert Counter((r["ref"], r["beg"], r["end_pos"], r["sv_type"], r["n_events"], r["n_reads"], r["n_tumour"], r["n_normal"], r["origin"], r["failed"], r["n_repeats"]) for r in got) == want and want


def test_q81(spark, sf, events):
    """The short-read pipeline: mates named by the first stage that covers them, clusters, majorities per side."""
    f = [r.asDict() for r in tb.features(spark, sf).collect()]
    stages = (("source", "SVA"), ("exon", "ERVK"), ("repeat", "Alu"))
    rows = []
    for r in events:
        if r["sv_type"] != "CLIPPING":
            continue
        b, e = r["end"] + 1000, r["end"] + 1100
        hit = next(((fam, s) for s, fam in stages if any(x["feat_family"] == fam and x["r_ref"] == r["ref"] and b <= x["r_end"] and x["r_beg"] <= e for x in f)), (None, None))
        rows.append(r | {"id": r["event_id"], "identity": hit[0], "stage": hit[1], "orientation": "MINUS" if r["is_reverse"] else "PLUS"})
    want = Counter()
    for c in sweep(rows, 1.0, 200, 2):
        sides = {}
        for o in ("PLUS", "MINUS"):
            n = Counter(r["identity"] for r in c if r["orientation"] == o)
            top = min((x for x in n if x is not None), key=lambda x: (-n[x], x), default=None)
            sides[o] = top if top is not None and n[top] / sum(n.values()) > 0.1 else None
        o = {r["orientation"] for r in c}
        want[(*extent(c), next(iter(o)) if len(o) == 1 else "RECIPROCAL", *support(c), sides["PLUS"], sides["MINUS"])] += 1
    got = CORE_QUERIES["q81_short_read_calls"](spark, sf).collect()
    assert Counter((r["ref"], r["beg"], r["end_pos"], r["orientation"], r["n_reads"], r["n_tumour"], r["n_normal"], r["plus"], r["minus"]) for r in got) == want and want
