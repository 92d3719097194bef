"""Queries over files: test tables written in each format to the shared folder, read back and returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..conf import EngineConf
from ..operators import events as ev
from ..session import new_folder, table
from ..sources import formats as fm
from . import tables as tb
from .reference import query
from .tables import AN_SQL, EV_SQL, LI_SQL, SQ_SQL


def _lines(df, path, mode="overwrite"):
    """Rows of one text column as files of lines."""
    df.write.mode(mode).text(path)


@query(f"WITH {EV_SQL}, {AN_SQL} SELECT r_ref AS ref, r_beg AS beg, r_end AS end_pos, row_id, coalesce(feat_family, 'NA') AS family, coalesce(strand, '.') AS strand FROM an")
def q84_bed_file(spark, sf):
    f = tb.features(spark, sf).select(F.col("r_ref").alias("ref"), F.col("r_beg").alias("beg"), F.col("r_end").alias("end"), "row_id", F.coalesce("feat_family", F.lit("NA")).alias("family"), F.coalesce("strand", F.lit(".")).alias("strand"))
    path = new_folder(spark)
    fm.write_bed(f, path, ["row_id", "family", "strand"])
    o = F.col("optional")
    return fm.read_bed(spark, path).select("ref", "beg", F.col("end").alias("end_pos"), o["row_id"].cast("bigint").alias("row_id"), o["family"].alias("family"), o["strand"].alias("strand"))


_HIT = "'q' || l_orderkey AS q_name, CAST(1000 AS BIGINT) AS q_len, CAST(l_linenumber * 10 AS BIGINT) AS q_beg, CAST(l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS BIGINT) AS q_end"


@query(f"SELECT {_HIT}, CASE WHEN l_linenumber % 2 = 1 THEN '-' ELSE '+' END AS strand, 't' || l_suppkey AS t_name, l_partkey AS t_beg, CAST(60 AS BIGINT) AS mapq, 'tp:A:P;cg:Z:' || CAST(l_quantity AS INTEGER) || 'M' AS tags FROM lineitem")
def q85_paf_file(spark, sf):
    """Twelve columns and tags; every hundredth line has eleven columns and is left out by the reader."""
    li = table(spark, sf, "lineitem").selectExpr("*", "cast(l_quantity as int) as q")
    text = F.expr("concat_ws('\\t', concat('q', l_orderkey), 1000, l_linenumber * 10, l_linenumber * 10 + q, if(l_linenumber % 2 = 1, '-', '+'), concat('t', l_suppkey), 9000000, l_partkey, l_partkey + q, q, q, 60, 'tp:A:P', concat('cg:Z:', q, 'M'))")
    path = new_folder(spark)
    _lines(li.select(text), path)
    _lines(spark.range(100).selectExpr("concat_ws('\\t', 'short', 1, 2, 3, '+', 't', 5, 6, 7, 8, 9)"), path, "append")
    return fm.read_paf(spark, path).select("q_name", "q_len", "q_beg", "q_end", "strand", "t_name", "t_beg", "mapq", F.array_join("tags", ";").alias("tags"))


@query(f"SELECT {_HIT}, 't' || l_suppkey AS t_name, l_partkey AS t_beg, CAST(CAST(l_quantity AS INTEGER) AS BIGINT) AS matches, round(CAST(l_quantity AS INTEGER) * 100.0 / 1000, 6) AS pct FROM lineitem")
def q86_psl_file(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("*", "cast(l_quantity as int) as q")
    text = F.expr(
        "concat_ws('\\t', q, 0, 0, 0, 0, 0, 0, 0, if(l_linenumber % 2 = 1, '-', '+'), concat('q', l_orderkey), 1000, l_linenumber * 10, l_linenumber * 10 + q, concat('t', l_suppkey), 9000000, l_partkey, l_partkey + q, 1, concat(q, ','), '0,', concat(l_partkey, ','))"
    )
    path = new_folder(spark)
    _lines(spark.createDataFrame([("psLayout version 3",), ("",), ("match\tmis-match",), ("-----",)], "value string"), path)
    _lines(li.select(text), path, "append")
    got = fm.read_psl(spark, path)
    return got.select("q_name", F.col("q_size").alias("q_len"), "q_beg", "q_end", "t_name", "t_beg", "matches", F.round((F.col("q_end") - F.col("q_beg")) * F.lit(100.0) / F.col("q_size"), 6).alias("pct"))


_VCF_INFO = {"ITYPE": ("1", "String", "Type of the insertion"), "LEN": ("1", "Integer", "Length"), "TD": ("0", "Flag", "Transduced")}


@query("""WITH d AS (SELECT DISTINCT call_id, chrom, pos, itype, len_bp, filter_status FROM ins_calls WHERE chrom IS NOT NULL AND pos IS NOT NULL),
v AS (SELECT chrom, pos, CAST(call_id AS VARCHAR) AS id, coalesce(filter_status, '.') AS filter, CASE WHEN itype = 'None' THEN NULL ELSE itype END AS itype, len_bp FROM d)
SELECT *, coalesce(len_bp % 2 = 0, false) AS td, (SELECT count(*) FROM contigs) AS n_contigs, 'Integer' AS len_type FROM v""")
def q87_vcf_file(spark, sf):
    """One valid file: its header declares the contigs and INFO entries, its body is in order."""
    d = table(spark, sf, "ins_calls").where("chrom is not null and pos is not null").select("call_id", "chrom", "pos", "itype", "len_bp", "filter_status").distinct()
    info = F.map_from_arrays(F.array(F.lit("ITYPE"), F.lit("LEN"), F.lit("TD")), F.array("itype", F.col("len_bp").cast("string"), F.expr("if(len_bp % 2 = 0, 'true', 'false')")))
    rows = d.select("chrom", "pos", F.col("call_id").alias("id"), F.lit("N").alias("ref"), F.lit("<INS>").alias("alt"), F.lit(None).cast("string").alias("qual"), F.col("filter_status").alias("filter"), info.alias("info"))
    header = fm.VcfHeader(source="test", reference="ref", species="none", info=_VCF_INFO)
    header.contigs = {r[0]: r[1] for r in fm.fixed_rows(table(spark, sf, "contigs").select("ref_name", "ref_len"))}
    path = new_folder(spark) + "/calls.vcf"
    fm.write_vcf(rows, path, header, ["ITYPE", "LEN", "TD"], "20200101", one_file=True)
    back = fm.read_vcf_header(spark, path)
    i = F.col("info")
    return fm.read_vcf(spark, path).select(
        "chrom", "pos", "id", "filter", i["ITYPE"].alias("itype"), i["LEN"].cast("bigint").alias("len_bp"), F.coalesce(i["TD"] == "true", F.lit(False)).alias("td"),
        F.lit(len(back.contigs)).cast("bigint").alias("n_contigs"), F.lit(back.info["LEN"][1]).alias("len_type"),
    )


@query(f"WITH {SQ_SQL} SELECT 's' || rec_no AS seq_id, 'record ' || rec_no AS description, CAST(length(seq) AS INTEGER) AS n, md5(seq) AS bases_md5 FROM sq")
def q88_fasta_file(spark, sf):
    """Records wrapped at 60 bases, read back whole."""
    s = tb.sequences(spark, sf).select(F.concat(F.lit("s"), "rec_no", F.lit(" record "), "rec_no").alias("seq_id"), F.regexp_replace("seq", "(.{60})(?=.)", "$1\n").alias("seq"))
    path = new_folder(spark)
    fm.write_fasta(s, path)
    return fm.read_fasta(spark, path).select("seq_id", "description", F.length("seq").alias("n"), F.md5("seq").alias("bases_md5"))


@query(f"""WITH {SQ_SQL}, r AS (SELECT 's' || rec_no AS seq_id, seq FROM sq WHERE length(seq) > 0)
SELECT unnest(['@' || seq_id || ' d', seq, '+', repeat('I', length(seq))]) AS line, unnest([0, 1, 2, 3]) AS kind FROM r""")
def q89_fastq_file(spark, sf):
    s = tb.sequences(spark, sf).where("length(seq) > 0").select(F.concat(F.lit("s"), "rec_no").alias("seq_id"), "seq", F.lit("d").alias("description"), F.expr("repeat('I', length(seq))").alias("qual"))
    path = new_folder(spark)
    fm.write_fastq(s, path)
    line = F.col("value")
    kind = F.when(line.startswith("@"), 0).when(line == "+", 2).when(line.rlike("^I+$"), 3).otherwise(1)
    return spark.read.text(path).select(line.alias("line"), kind.alias("kind"))


@query("""SELECT 's' || l_suppkey AS seq_id, l_partkey - 1 AS beg, l_partkey + l_linenumber * 6 - 1 AS end_pos, CAST(6 AS INTEGER) AS period, CAST(l_linenumber AS DOUBLE) AS copies, 'TTAGGG' AS motif FROM lineitem""")
def q90_trf_file(spark, sf):
    """Blocks of tandem repeats, one per sequence, each record of 17 columns."""
    row = "concat_ws(' ', l_partkey, l_partkey + l_linenumber * 6, 6, l_linenumber, 6, 100, 0, 12, 0, 17, 50, 33, 1.46, 'TTAGGG', repeat('TTAGGG', l_linenumber), 'A', 'C')"
    li = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_list(F.expr(row)).alias("r"))
    path = new_folder(spark)
    _lines(li.select(F.concat(F.lit("@s"), "l_suppkey", F.lit("\n"), F.array_join("r", "\n"))), path)
    return fm.read_trf(spark, path).select("seq_id", "beg", F.col("end").alias("end_pos"), "period", "copies", "motif")


_READS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _sam(spark, sf):
    li = tb.cigars(spark, sf)
    name = F.concat_ws("_", *_READS, "qty")
    flag = F.expr("if(l_linenumber % 2 = 1, 16, 0)")
    text = F.concat_ws("\t", name, flag, F.expr("concat('chr', l_suppkey % 22 + 1)"), F.col("l_partkey") * 1000 + 1, F.lit(60), "cigar", F.lit("*"), F.lit(0), F.lit(0), F.lit("ACGT"), F.lit("IIII"), F.lit("SA:Z:chr1,7,+,5M,60,0;"))
    path = new_folder(spark)
    _lines(spark.createDataFrame([("@HD\tVN:1.6",), ("@SQ\tSN:chr1\tLN:9",)], "value string"), path)
    _lines(li.select(text), path, "append")
    return fm.read_sam(spark, path)


_SAM_SQL = f"""{LI_SQL}, sam AS (SELECT concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey, qty) AS read_name, 'chr' || (l_suppkey % 22 + 1) AS ref, l_partkey * 1000 AS beg,
  l_linenumber * 3 AS clip, qty + 10 AS m1, l_partkey % 90 + 1 AS ins, l_suppkey % 80 + 5 AS m2, l_orderkey % 70 + 1 AS del, l_linenumber + 7 AS m3, l_linenumber % 2 = 1 AS is_reverse FROM li)"""


@query(f"WITH {_SAM_SQL} SELECT read_name, ref, beg, CAST(beg + m1 + m2 + del + m3 AS BIGINT) AS end_pos, CAST(60 AS INTEGER) AS mapq, is_reverse, false AS is_dup, 'chr1,7,+,5M,60,0;' AS sa FROM sam")
def q91_sam_file(spark, sf):
    return _sam(spark, sf).select("read_name", "ref", "beg", F.col("end").alias("end_pos"), "mapq", "is_reverse", "is_dup", "sa")


@query(f"""WITH {_SAM_SQL} SELECT read_name, 'INS' AS sv_type, beg + m1 AS beg, beg + m1 AS end_pos, CAST(ins AS BIGINT) AS len, CAST(NULL AS VARCHAR) AS side FROM sam WHERE ins >= 50
UNION ALL SELECT read_name, 'DEL', beg + m1 + m2, beg + m1 + m2 + del, CAST(del AS BIGINT), NULL FROM sam WHERE del >= 50
UNION ALL SELECT read_name, 'CLIPPING', beg, beg, CAST(clip AS BIGINT), 'left' FROM sam WHERE clip >= 10""")
def q92_event_scan(spark, sf):
    """The event scan over the alignments of SAM files: insertions, deletions and clippings with their sizes."""
    got = ev.collect_events(_sam(spark, sf), EngineConf())
    return got.select("read_name", "sv_type", "beg", F.col("end").alias("end_pos"), "len", "side")


@query(f"""WITH {_SAM_SQL} SELECT read_name, ref, beg FROM sam WHERE ref = 'chr7' AND beg <= 900000 AND beg + m1 + m2 + del + m3 >= 200000""")
def q93_region_scan(spark, sf):
    """Alignments ingested as a table in order of position: the region's bounds reach the scan as pushed filters."""
    path = new_folder(spark)
    ev.ingest(_sam(spark, sf), path)
    return ev.in_region(spark.read.parquet(path), "chr7", 200_000, 900_000).select("read_name", "ref", "beg")


@query("""SELECT CAST(l_partkey AS VARCHAR) AS ref, CAST(l_linenumber * 100 AS BIGINT) AS beg, 'c' || (l_suppkey % 50) AS cell_id, CASE WHEN l_linenumber % 2 = 0 THEN 'del' ELSE 'complex' END AS sv_class,
  CASE WHEN l_linenumber % 2 = 0 THEN 'h1' END AS haplotype, l_linenumber / 10.0 AS af FROM lineitem""")
def q94_cell_file(spark, sf):
    row = "concat_ws('\\t', concat('chr', l_partkey), l_linenumber * 100, l_linenumber * 100 + 50, 's', concat('c', l_suppkey % 50), 'x', 1.5, 3, if(l_linenumber % 2 = 0, 'del_h1', 'complex'), 'k', 'none', 'k', 'NA', 'NA', l_linenumber / 10)"
    path = new_folder(spark)
    _lines(spark.createDataFrame([("chrom\tstart\tend",)], "value string"), path)
    _lines(table(spark, sf, "lineitem").select(F.expr(row)), path, "append")
    return fm.read_cell_svs(spark, path).select("ref", "beg", "cell_id", "sv_class", "haplotype", "af")


@query("SELECT ref_name, ref_len FROM contigs")
def q95_fai_file(spark, sf):
    path = new_folder(spark)
    _lines(table(spark, sf, "contigs").select(F.concat_ws("\t", "ref_name", "ref_len", F.lit(0), F.lit(60), F.lit(61))), path)
    return fm.read_fai(spark, path)


@query(f"WITH {EV_SQL} SELECT 'e' || event_id AS name, 'exonic' AS region, 'G' || (event_id % 9) AS gene, ref || ':' || beg AS at FROM ev")
def q96_annotator_files(spark, sf):
    """The annotator's input as written, and a result in its columns as read."""
    e = tb.settled_events(spark, sf).select("event_id", "ref", "beg", "end", F.concat(F.lit("e"), "event_id").alias("name"))
    asked, told = new_folder(spark), new_folder(spark)
    fm.write_annotator_input(e, asked)
    f = F.split("value", "\t")
    given = spark.read.text(asked).select(F.regexp_replace(f[5], "^comments: ", "").alias("name"), F.concat_ws(":", f[0], f[1]).alias("at"))
    _lines(e.select(F.concat_ws("\t", F.lit("exonic"), F.concat(F.lit("G"), F.col("event_id") % 9), "ref", "beg", "end", F.lit(0), F.lit(0), F.lit("comments:"), "name")), told)
    return fm.read_annotator_output(spark, told).join(given, "name").select("name", "region", "gene", "at")
