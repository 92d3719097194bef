import numpy as np
from pyspark.sql import functions as F

from locusloom.functions import sequences
from locusloom.operators import clustering as cl
from locusloom.operators import databases as db
from locusloom.operators import events as ev
from locusloom.operators import retro
from locusloom.operators import singlecell as sc
from locusloom.sources import formats as fm


def test_shifted_coordinates(spark):
    df = spark.createDataFrame([("t", 5, 9, "t,3,+,5M,60,0;t,4,-,6M,1,2;"), ("t", 1, 2, None)], "ref string, beg long, end long, sa string")
    got = [tuple(r) for r in ev.shift_coords(df, "chr9", 100).orderBy("beg").collect()]
    assert got == [("chr9", 101, 102, None), ("chr9", 105, 109, "chr9,103,+,5M,60,0;chr9,104,-,6M,1,2;")]


def test_clippings_in_breakpoint_areas(spark):
    d = spark.createDataFrame([("m", 100, 150, False), ("m", 120, 180, True), ("n", 10, 20, False)], "meta string, beg long, end long, clip boolean")
    areas = ev.breakpoint_area(d, "meta", "PLUS", 300)
    assert {(r.meta, r.area_beg, r.area_end, r.from_clip) for r in areas.collect()} == {("m", 175, 185, True), ("n", 10, 320, False)}
    clips = spark.createDataFrame([(1, "r", 180, "right"), (2, "r", 180, "left"), (3, "r", 190, "right"), (4, "r", 300, "right")], "event_id int, ref string, beg long, side string")
    got = ev.supporting_clippings(areas.withColumn("ref", F.lit("r")), clips, "meta", "right")
    assert {(r.meta, r.event_id) for r in got.collect()} == {("m", 1), ("n", 1), ("n", 3), ("n", 4)}
    near = ev.near_matched(got, got.where("event_id = 1"), "meta")
    assert {(r.meta, r.event_id) for r in near.collect()} == {("m", 1), ("n", 1)}
    src = got.withColumn("source", F.when(F.col("event_id") == 3, "matched").otherwise("regular"))
    assert {(r.meta, r.event_id) for r in ev.best_source(src, "meta").collect()} == {("m", 1), ("n", 3)}


def test_representative_text(spark):
    df = spark.createDataFrame([(1, "right", "AAA", "CC"), (1, "right", "AA", "CCCC"), (2, "left", "GG", "T")], "k int, side string, r string, c string")
    assert {tuple(x) for x in ev.representative(df, "k", "r", "c").collect()} == {(1, "AA[INT]>CCCC"), (2, "T<[INT]GG")}
    assert df.select(ev.inserted_between(F.lit("ACGTACGT"), F.lit(6), F.lit(2))).first()[0] == "GTAC"


def test_reclustering(spark):
    df = spark.createDataFrame([(1, "a", 10, 20, 1), (1, "a", 15, 90, 2), (1, "a", 500, 91, 3), (1, "b", 16, 5, 4), (2, "a", 1, 2, 5)], "c int, ref string, beg long, end long, i int")
    got = {r.i: (r.c, r.ref, r.sub_no) for r in cl.recluster(df, "c", "ref", "beg", 100, ["i"]).collect()}
    assert got == {1: (1, "a", 1), 2: (1, "a", 1), 3: (1, "a", 2), 4: (1, "b", 1), 5: (2, "a", 1)}
    assert {r.i for r in cl.recluster(df, "c", "ref", "beg", 100, ["i"], 2).collect()} == {1, 2}
    assert {tuple(r) for r in cl.larger_side(df, "c", "ref", 20, ["i"]).collect()} == {(1, "beg"), (2, "beg")}


def test_density_clusters():
    x = np.array([[0.0], [0.5], [1.0], [9.0], [9.2], [30.0]])
    assert cl.density_labels(x, 1.0, 2).tolist() == [0, 0, 0, 1, 1, -1]
    assert cl.density_labels(np.zeros((0, 1)), 1.0, 2).tolist() == []


def test_dense_windows(spark):
    rows = [(i, "c", "r", 10_000_000 * w + 100 * i, 10_000_000 * w + 100 * i + 150) for w, n in ((0, 6), (1, 6), (5, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "event_id int, cell_id string, ref string, beg long, end long")
    assert {(r.window, r.n_sv) for r in sc.dense_windows(df).collect()} == {(0, 6), (1, 6)}


def test_typing_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    hits = lambda *h: F.array(*[F.struct(F.lit(a).alias("in_source"), F.lit(b).alias("in_repeat")) for a, b in h])
    assert one(retro.interspersed_type(hits((True, False), (False, True)), F.lit(False))) == "partnered"
    assert one(retro.interspersed_type(hits((True, False)), F.lit(False))) == "orphan"
    assert one(retro.interspersed_type(hits((False, False)), F.lit(False))) is None and one(retro.interspersed_type(hits((False, False)), F.lit(True))) == "solo"
    assert tuple(one(retro.short_read_tail(F.lit("CCAAAACAAAA")))) == (True, False) and tuple(one(retro.short_read_tail(F.lit("TTTTTTTTG")))) == (False, True)
    calls = F.array(*[F.struct(F.lit(b).alias("beg"), F.lit(e).alias("end"), F.lit(m).alias("motif")) for b, e, m in ((0, 10, "AC"), (12, 60, "G"))])
    assert tuple(one(retro.tandem_repeat(calls, F.lit(100), 50.0))) == (True, 60.0, 2, ["AC", "G"])
    assert one(retro.tail_length(calls, F.lit(70), 15)) == 48 and one(retro.cut_out(F.lit("ABCDEF"), F.lit(2), F.lit(4))) == "ABEF"
    hexa = F.array(F.struct(F.lit(5).alias("beg"), F.lit(50).alias("end"), F.lit(5).alias("a"), F.lit(60).alias("c"), F.lit(5).alias("g"), F.lit(30).alias("t")))
    assert len(one(retro.hexamer_calls(hexa, F.lit(1000), F.lit("+")))) == 1 and one(retro.hexamer_calls(hexa, F.lit(1000), F.lit("-"))) == []


def test_collections(spark):
    lib = spark.createDataFrame([("L1HS#LINE/L1", "ACGTAAaA"), ("X#y", "C")], "seq_id string, seq string")
    fam = spark.createDataFrame([("L1HS", "L1")], "subfamily string, family string")
    con = db.consensus_db(lib, fam)
    assert [tuple(r) for r in con.collect()] == [("consensus|L1|L1HS", "ACGT")]
    chunks = sequences.chunked(spark.createDataFrame([("r", "AACCGGTTAC")], "ref string, seq string"), 4)
    src = spark.createDataFrame([("r", 2, 4, "1p", "L1", "+"), ("r", 5, 8, "2q", "L1", "-")], "ref string, beg long, end long, band string, family string, strand string")
    got = {r.seq_id: r.seq for r in db.transduced_db(src, chunks, 4, 3).collect()}
    assert got == {"transduced|L1|1p|r:2-4": "GGT", "transduced|L1|2q|r:5-8": "CCG"}
    assert db.joined_db([con, con]).count() == 1
    m = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "k int, specific string")
    assert [tuple(r) for r in db.identity_db(m, spark.createDataFrame([("b", "T")], "seq_id string, seq string"), "k").collect()] == [(1, "b", "T")]


def test_vcf_of_calls(spark):
    df = spark.createDataFrame([("chr1", 5, [], "L1", None), ("chr2", 7, ["CV", "GERMLINE"], None, 3)], "ref string, mean_pos long, failed_filters array<string>, fam string, n int")
    got = [(r.chrom, r.pos, r.filter, r.info) for r in fm.calls_to_vcf(df, {"FAM": F.col("fam"), "N": F.col("n")}).collect()]
    assert got == [("chr1", 5, "PASS", {"FAM": "L1"}), ("chr2", 7, "CV,GERMLINE", {"N": "3"})]
    v = spark.createDataFrame([("chr1", 100, {"ITYPE": "solo", "FAM": "L1", "INSEQ": "ACG", "CIPOS": "-2,3"}), ("chr1", 200, {"ITYPE": "solo"})], "chrom string, pos long, info map<string,string>")
    assert [tuple(r) for r in fm.insertions_to_fasta(v, "solo", "L1").collect()] == [("chr1_100_L1", "ACG")]
    assert {(r.beg, r.end, r.kind) for r in fm.insertion_intervals(v).collect()} == {(98, 103, "solo-L1"), (200, 200, "solo")}


def test_annotator_files_and_sa_text(spark, tmp_path):
    e = spark.createDataFrame([("chr1", 5, 9, "chr1:5-9")], "ref string, beg long, end long, name string")
    fm.write_annotator_input(e, str(tmp_path / "in"))
    assert spark.read.text(str(tmp_path / "in")).first()[0] == "chr1\t5\t9\t0\t0\tcomments: chr1:5-9"
    (tmp_path / "out").write_text("exonic GENE chr1 5 9 0 0 comments: chr1:5-9\n")
    assert [tuple(r) for r in fm.read_annotator_output(spark, str(tmp_path / "out")).collect()] == [("chr1:5-9", "exonic", "GENE")]
    h = spark.createDataFrame([("q", 0, 40, 100, "t", 7, "+")], "q_name string, q_beg long, q_end long, q_size long, t_name string, t_beg long, strand string")
    assert fm.hits_as_sa(h, F.lit("left")).first().sa == "t,7,+,40M60H,0,0;"
