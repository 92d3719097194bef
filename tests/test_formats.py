"""Readers and writers: round trips and the odd lines that the formats allow."""

from pyspark.sql import functions as F

from locusloom.sources import formats as fm


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta_round_trip(spark, tmp_path):
    p = write(tmp_path, "a.fa", ">s1 first one\nACGT\nacg\n>s2\r\nNN\r\n>s3\n\n>s4 x\nA>C\n")
    rows = {r.seq_id: (r.description, r.seq) for r in fm.read_fasta(spark, p).collect()}
    assert rows["s1"] == ("first one", "ACGTacg") and rows["s2"] == ("", "NN") and rows["s3"] == ("", "")
    fm.write_fasta(fm.read_fasta(spark, p).where("seq_id in ('s1', 's2')"), str(tmp_path / "out"))
    assert {(r.seq_id, r.seq) for r in fm.read_fasta(spark, str(tmp_path / "out")).collect()} == {("s1", "ACGTacg"), ("s2", "NN")}
    both = fm.merge_fasta([spark.createDataFrame([("a", "A"), ("b", "C")], "seq_id string, seq string"), spark.createDataFrame([("a", "G")], "seq_id string, seq string")])
    assert {tuple(r) for r in both.collect()} == {("a", "G"), ("b", "C")}


def test_bed_headers(spark, tmp_path):
    p = write(tmp_path, "a.bed", "#ref beg end name family\nchr1 1 5 n1 Alu\nchr2\t3\t9\tn2\n")
    rows = [(r.ref, r.beg, r.end, r.optional) for r in fm.read_bed(spark, p).orderBy("ref").collect()]
    assert rows == [("chr1", 1, 5, {"name": "n1", "family": "Alu"}), ("chr2", 3, 9, {"name": "n2"})]
    assert fm.read_bed(spark, p, ["chr2"]).count() == 1
    bare = write(tmp_path, "b.bed", "chr1\t1\t5\nchr1\t2\t6\tx\n")
    assert [r.optional for r in fm.read_bed(spark, bare).orderBy("beg").collect()] == [{}, {"column4": "x"}]
    fm.write_bed(fm.read_bed(spark, p).withColumn("name", F.col("optional")["name"]), str(tmp_path / "out"), ["name"])
    assert {r.optional["name"] for r in fm.read_bed(spark, str(tmp_path / "out")).collect()} == {"n1", "n2"}


def test_paf_psl_fai(spark, tmp_path):
    paf = write(tmp_path, "a.paf", "q\t100\t0\t50\t+\tt\t1000\t10\t60\t40\t50\t60\ttp:A:P\nshort\t1\n")
    r = fm.read_paf(spark, paf).collect()
    assert len(r) == 1 and r[0].t_end == 60 and r[0].tags == ["tp:A:P"]
    psl = write(tmp_path, "a.psl", "\t".join(["95", *["0"] * 7, "+", "q", "100", "0", "95", "t", "500", "5", "100", "1", "95,", "0,", "5,"]) + "\nmatch\tmis\n")
    r = fm.read_psl(spark, psl).collect()
    assert len(r) == 1 and (r[0].q_name, r[0].q_size, r[0].t_end) == ("q", 100, 100)
    assert [tuple(x) for x in fm.read_fai(spark, write(tmp_path, "a.fai", "chr1\t1000\t6\t60\t61\n")).collect()] == [("chr1", 1000)]


def test_vcf_round_trip(spark, tmp_path):
    text = (
        '##fileformat=VCFv4.2\n##source=x\n##contig=<ID=chr1,length=1000>\n##INFO=<ID=LEN,Number=1,Type=Integer,Description="Length">\n'
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\nchr2\t5\t.\tA\t<INS>\t.\tPASS\tLEN=7;TD;CIPOS=-3,4\tGT:AD\t0/1:5\nchr1\t9\tv\tA\tC\t1\tPASS\t.\n"
    )
    p = write(tmp_path, "a.vcf", text)
    h, v = fm.read_vcf_header(spark, p), fm.read_vcf(spark, p)
    assert h.contigs == {"chr1": 1000} and h.info["LEN"][1] == "Integer" and h.samples == ["s1"]
    rows = {r.chrom: r for r in v.collect()}
    assert rows["chr2"].info == {"LEN": "7", "TD": "true", "CIPOS": "-3,4"} and rows["chr1"].info == {} and rows["chr2"].genotypes == ["0/1:5"]
    i = v.where("chrom = 'chr2'").select(fm.pos_interval(F.col("pos"), F.col("info")["CIPOS"]).alias("i"), fm.build_info(F.col("info"), ["TD", "LEN", "NO"]).alias("t")).first()
    assert tuple(i.i) == (2, 9) and i.t == "TD;LEN=7"
    fm.write_vcf(v, str(tmp_path / "out"), h, ["LEN", "TD"], "20240101")
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out/body")).collect()]
    assert all(x.endswith("\t") for x in lines) and {x.split("\t")[0] for x in lines} == {"chr1", "chr2"}
    assert spark.read.text(str(tmp_path / "out/header")).first()[0] == "##fileformat=VCFv4.2"


def test_trf_and_cell_tables(spark, tmp_path):
    line = "5 20 3 5.0 3 90 0 30 25 25 25 25 1.9 ACG ACGACG"
    rows = fm.read_trf(spark, write(tmp_path, "a.trf", f"@s1 x\n{line}\n{line}\n@s2\n@s3\n{line} . .\n")).collect()
    assert [(r.seq_id, r.beg, r.end, r.motif) for r in rows] == [("s1", 4, 19, "ACG"), ("s1", 4, 19, "ACG"), ("s3", 4, 19, "ACG")]
    cells = write(tmp_path, "c.txt", "chrom start end\nchr7 1 9 s c1 WC 1.0 3 del_h1 1 complex 2 3.5 1.5 0.25\n")
    r = fm.read_cell_svs(spark, cells).first()
    assert (r.ref, r.sv_class, r.haplotype, r.sv_class2, r.haplotype2, r.af) == ("7", "del", "h1", "complex", None, 0.25)


def test_sam_to_paf_and_fastq(spark, tmp_path):
    sam = write(tmp_path, "a.sam", "@HD\tVN:1\nr1\t16\tchr1\t101\t60\t5S10M\t=\t1\t0\tAACCGGTTACGTACG\tABCDEFGHIJKLMNO\tNM:i:0\tSA:Z:chr2,5,+,5M10S,60,0;\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    reads = fm.read_sam(spark, sam)
    r = {x.read_name: x for x in reads.collect()}
    assert (r["r1"].beg, r["r1"].end, r["r1"].is_reverse, r["r1"].sa) == (100, 110, True, "chr2,5,+,5M10S,60,0;") and r["r2"].is_unmapped
    p = fm.reads_to_paf(reads).collect()
    assert len(p) == 1 and (p[0].q_len, p[0].q_beg, p[0].q_end, p[0].strand, p[0].t_len, p[0].matches) == (15, 5, 15, "-", 10, 0)
    q = {x.seq_id: (x.seq, x.qual) for x in fm.reads_to_fastq(reads).collect()}
    assert q["r1"] == ("CGTACGTAACCGGTT", "ONMLKJIHGFEDCBA")
    fm.write_fastq(fm.reads_to_fastq(reads), str(tmp_path / "fq"))
    assert spark.read.text(str(tmp_path / "fq")).count() == 8
