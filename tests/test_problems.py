"""The core operators of the training-data problems: brute force, nulls, ties, repeats, empty input, name clashes."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusloom.operators.hotkeys import exact_quantiles, key_profile
from locusloom.operators.periods import periods_and_gaps
from locusloom.operators.widen import PLACEHOLDERS, other_attributes, widen
from locusloom.plans.problems import PROBLEMS
from locusloom.sources.records import parse_lines, parse_text


def brute_periods(rows):
    by = defaultdict(list)
    for k, b, e in rows:
        if b is not None and e is not None and e > b:
            by[k].append((b, e))
    out = set()
    for k, iv in by.items():
        iv.sort()
        merged = [list(iv[0])]
        for b, e in iv[1:]:
            if b <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e])
        out |= {(k, "period", b, e) for b, e in merged}
        out |= {(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed,width,shards", [(1, 16, 8), (2, 7, 4096), (3, 1000, 4), (4, 1, 50)])
def test_periods_against_brute_force(spark, seed, width, shards):
    rng = random.Random(seed)
    rows = []
    for _ in range(300):
        b = rng.randint(-20, 300)
        rows.append((rng.choice(["a", "b", None]), b, b + rng.choice([0, 1, 2, 3, 10, 80, -4])))
    rows += rows[:30] + [("a", None, 3), ("a", 3, None), ("c", 5, 5)]
    df = spark.createDataFrame([(k, b, e, "x", 1) for k, b, e in rows], "key string, beg long, end_pos long, kind string, __k0 int")
    got = periods_and_gaps(df, ["key"], "beg", "end_pos", width, shards).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {(r["key"], r["kind"], r["beg"], r["end_pos"]) for r in got} == brute_periods(rows)


def test_periods_empty_and_huge(spark):
    schema = "key string, beg long, end_pos long"
    assert periods_and_gaps(spark.createDataFrame([], schema), ["key"], "beg", "end_pos").count() == 0
    df = spark.createDataFrame([("a", 0, 10**15), ("a", 10**15, 10**15 + 5), ("a", 10**16, 10**16 + 1)], schema)
    got = {(r["kind"], r["beg"], r["end_pos"]) for r in periods_and_gaps(df, ["key"], "beg", "end_pos").collect()}
    assert got == {("period", 0, 10**15 + 5), ("gap", 10**15 + 5, 10**16), ("period", 10**16, 10**16 + 1)}


ATTR = "row_no long, variant_id long, attr_name string, attr_value string, loaded_at int, __e string"


def test_widen_rules(spark):
    rows = [
        (1, 1, " len", "12", 5, ""), (2, 1, "LEN ", "13", 5, ""), (3, 1, "Len", "x", 9, ""), (4, 1, "FAM", " Alu\t", 1, ""), (5, 1, "FAM", "N/A", 7, ""),
        (6, 2, "FULL", None, 1, ""), (7, 3, "FULL", "False", 1, ""), (8, 4, "OTHER", "z", 1, ""), (9, 5, None, None, None, ""), (10, None, "LEN", "3", 1, ""),
        (11, 6, "LEN", "99999999999999999999", 1, ""), (12, 6, "CV", "1.5e1", 1, ""), (12, 6, "CV", "1.5e1", 1, ""), (13, 7, "LEN", "+7", None, ""), (14, 7, "LEN", "-8", 0, ""),
    ]
    cols = [("FAM", "String"), ("LEN", "Integer"), ("CV", "Float"), ("FULL", "Flag")]
    df = spark.createDataFrame(rows, ATTR)
    got = {r["variant_id"]: (r["FAM"], r["LEN"], r["CV"], r["FULL"]) for r in widen(df, cols, defaults={"FULL": 0}).collect()}
    assert got == {1: ("Alu", 13, None, 0), 2: (None, None, None, 1), 3: (None, None, None, 0), 4: (None, None, None, 0), 5: (None, None, None, 0), 6: (None, None, 15.0, 0), 7: (None, -8, None, 0)}
    assert widen(df.limit(0), cols).count() == 0
    assert widen(df.repartition(7).orderBy(F.rand(3)), cols, defaults={"FULL": 0}).count() == 7


def test_wide_all_carries_what_is_listed_nowhere(spark, sf):
    squeezed = lambda v: re.sub(r"^\s+|\s+$", "", v)
    declared = {r[0].strip().upper() for r in spark.read.parquet(f"{sf}/info_defs.parquet").select("attr_name").collect()}
    want = {}
    for r in sorted(spark.read.parquet(f"{sf}/vcf_info.parquet").collect(), key=lambda r: (r["loaded_at"], r["row_no"])):
        name, v = squeezed(r["attr_name"] or "").upper(), squeezed(r["attr_value"] or "")
        if name not in declared and v.upper() not in PLACEHOLDERS:
            want.setdefault(r["variant_id"], {})[name] = v
    all_ = PROBLEMS["p2_wide_all"](spark, sf)
    assert want and {r["variant_id"]: dict(r["others"]) for r in all_.where("others is not null").collect()} == want
    key = lambda r: r["variant_id"]
    assert sorted(all_.drop("others").collect(), key=key) == sorted(PROBLEMS["p2_wide"](spark, sf).collect(), key=key)


def test_other_attributes_rules(spark):
    rows = [
        (1, 1, " x_a", "1", 5, ""), (2, 1, "X_A ", "2", 5, ""), (3, 1, "X_A", "n/a", 9, ""), (4, 1, "X_0", " q\t", None, ""), (5, 1, "FAM", "Alu", 1, ""),
        (6, 2, "X_A", ".", 1, ""), (7, None, "X_A", "3", 1, ""), (8, 3, None, "3", 1, ""), (9, 3, " ", "3", 1, ""),
    ]
    df = spark.createDataFrame(rows, ATTR)
    got = [(r["variant_id"], [tuple(x) for x in r["others"]]) for r in other_attributes(df, [("fam", "String")]).collect()]
    assert got == [(1, [("X_0", "q"), ("X_A", "2")])]


def test_widen_hot_entity_and_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        df = spark.range(6000).selectExpr("id as row_no", "if(id % 3 = 0, 0, id div 7) as variant_id", "concat('a', id % 5) as attr_name", "cast(id as string) as attr_value", "id as loaded_at", "'' as __e")
        cols = [(f"A{i}", "Integer") for i in range(5)]
        got = {r["variant_id"]: tuple(r[f"A{i}"] for i in range(5)) for r in widen(df, cols).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(lambda: [None] * 5)
    for i in range(6000):
        want[0 if i % 3 == 0 else i // 7][i % 5] = i
    assert got == {k: tuple(v) for k, v in want.items()}


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_exact_quantiles(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([None, 0, 5, -7, 10**12, -(10**12), rng.randint(-50, 50)])) for _ in range(500)] + [("lone", 3), ("none", None)]
    df = spark.createDataFrame(rows, "key string, v long").withColumn("__k", F.lit(1))
    got = {(r["key"], r["prob_k"]): r["value"] for r in exact_quantiles(df, "key", "v", [0.001, 0.5, 0.9, 1.0], bits).collect()}
    by = defaultdict(list)
    for k, v in rows:
        if v is not None:
            by[k].append(v)
    want = {(k, p): sorted(v)[max(1, -(-p * len(v) // 1000)) - 1] for k, v in by.items() for p in (1, 500, 900, 1000)}
    assert got == want
    assert exact_quantiles(df.limit(0), "key", "v", [0.5]).count() == 0


def test_key_profile(spark):
    rows = [(1, "a", "r1", 1, 10, 1), (1, "a", "r2", 5, 6, 2), (2, "a", None, None, None, 1), (3, "b", "r1", 2, 3, 1), (4, None, "r", 1, 1, 1), (None, "a", "r9", 0, 0, 1)]
    df = spark.createDataFrame(rows, "id long, k string, read string, beg long, fin long, t int")
    c = F.col
    run = lambda d, share: {r["hot_key"]: (r["n_ids"], r["n_distinct"], r["lo"], r["hi"], r["q50"]) for r in key_profile(d, "id", "t", c("k"), c("read"), c("beg"), c("fin"), c("fin"), [0.5], share).collect()}
    assert run(df, 0.0) == {"a": (2, 1, 5, 6, 6), "b": (1, 1, 2, 3, 3)}
    assert set(run(df, 0.5)) == {"a"}
    assert run(df.limit(0), 0.0) == {} and run(df.limit(0), 0.05) == {}


CONTIGS = [("chr1", 1000, "1", "QZ1")]
LINES = [
    ("chr1\t1\t5\tn\tAlu\t+", None), ("chr1\t1\t5\tn\tAlu\t+\r", None), ("chr1\t1\t5\tn\tAlu\t+\r\r", "strand"), ('chr1\t1\t5\t"a\tb ""q"""\tAlu\t.', None), ('chr1\t1\t5\t"a\tAlu\t+', "quoting"),
    ('chr1\t1\t5\t"a"x\tAlu\t+', "quoting"), ('chr1\t1\t5\ta"x\tAlu\t+', None), ("chr1\t1\t5\tn\tAlu", "columns"), ("chr1\t5\t5\tn\tAlu\t+", "range"), ("chr1\t-1\t5\tn\tAlu\t+", "number"),
    ("chr1\t1\t1234567890123456789\tn\tAlu\t+", "number"), ("chr1\t1\t٥\tn\tAlu\t+", "number"), ("chr1\t1\t5\t \tAlu\t+", "name"), ('chr1\t1\t5\t""\tAlu\t+', "name"), ("chr1\t1\t5\tné\tAlu\t+", "name"),
    ("Chr1\t1\t5\tn\tAlu\t+", "ref"), ("QZ1\t1\t5\tn\tAlu\t+", None), ("1\t1\t5\tn\tAlu\t*", "strand"), ('"chr1"\t"1"\t5\tn\tAlu\t"+"\r', None), ("chr1\t1\t5\tn\tAlu\t+\t", "columns"),
]


def test_bed_lines(spark):
    odd = ["", "  ", "\r", "# x", "track a", "browser\tb", None]
    rows = [(i, "bed", t) for i, (t, _) in enumerate(LINES)] + [(100 + i, "bed", t) for i, t in enumerate(odd)] + [(200, "gff", "x"), (201, None, "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "line_id long, fmt string, raw_line string, reason string")
    contigs = spark.createDataFrame(CONTIGS, "ref_name string, ref_len long, alias_name string, accession string")
    got = {r["line_id"]: r["reason"] for r in parse_lines(df, contigs, "line_id", "fmt", "raw_line").collect()}
    assert got == {i: r for i, (_, r) in enumerate(LINES)}
    assert parse_lines(df.limit(0), contigs, "line_id", "fmt", "raw_line").count() == 0


PAF = ["q", "100", "0", "50", "+", "chr1", "1000", "10", "60", "40", "50", "60"]


@pytest.mark.parametrize("at,value,reason", [(4, ".", "strand"), (3, "101", "range"), (2, "50", "range"), (8, "1001", "range"), (9, "51", "range"), (11, "256", "range"), (11, "255", None), (10, "x", "number"), (5, " ", "name"), (5, "chr2", "ref")])
def test_paf_lines(spark, at, value, reason):
    f = [*PAF[:at], value, *PAF[at + 1 :], "tp:A:P"]
    df = spark.createDataFrame([(1, "paf", "\t".join(f))], "line_id long, fmt string, raw_line string")
    contigs = spark.createDataFrame(CONTIGS, "ref_name string, ref_len long, alias_name string, accession string")
    assert [r["reason"] for r in parse_lines(df, contigs, "line_id", "fmt", "raw_line").collect()] == [reason]


def test_recovery_resumes_at_anchor():
    good = "chr1\t1\t5\tn\tAlu\t+"
    text = "\n".join([good, 'chr1\t1\t5\t"open\tAlu\t+', good, "not a record", good, 'chr1\t1\t5\tn\t"two\nlines"\t+', 'chr1\t1\t5\t"x"y\tAlu\t+', "#c", good])
    rows = list(parse_text(text, "bed"))
    assert [r.get("reason") for r in rows] == [None, "quoting", None, "columns", None, None, "quoting", None]
    bad = rows[1]
    assert text[bad["error_off"]] == '"' and text[bad["rec_off"] :].startswith("chr1\t1\t5\t\"open")
    assert rows[5]["family"] == "two\nlines"
    assert list(parse_text("", "bed")) == []


def test_lines_between_an_error_and_the_next_record_are_not_lost():
    lines = ['chr1\t1\t5\t"open\tAlu\t+', "chr1\tx\t5\tn\tAlu\t+", "# no record", "chr1\t1", '"chr""1"\t2\t6\ta\tAlu\t+', "chr1\t3\t7\tb\tAlu\t-"]
    text = "\n".join(lines)
    got = [(r["rec_off"], r.get("reason"), r.get("ref_field")) for r in parse_text(text, "bed")]
    at = [len("\n".join([*lines[:i], ""])) for i in range(len(lines))]
    assert got == [(at[0], "quoting", None), (at[1], "number", None), (at[3], "columns", None), (at[4], None, 'chr"1'), (at[5], None, "chr1")]


def test_very_long_line():
    name = "n" * 1_000_000
    (row,) = parse_text(f'chr1\t1\t5\t"{name}"\tAlu\t+', "bed", multiline=False)
    assert row["name"] == name
