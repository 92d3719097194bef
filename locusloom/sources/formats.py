"""Readers and writers of genomic text formats as plain Spark scans and sinks.

Row formats (BED, PAF, PSL, .fai, single-cell tables, SAM, VCF bodies) are line-parallel. Formats whose records span
lines (FASTA, FASTQ, TRF) are read with a record separator, so a file of any size still splits over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_checked, fixed_rows

PAF_COLUMNS = ("q_name", "q_len", "q_beg", "q_end", "strand", "t_name", "t_len", "t_beg", "t_end", "matches", "block_len", "mapq")
_PAF_TEXT = ("q_name", "strand", "t_name")
#: The 21 columns of PSL in the format's order (fixed values).
PSL_COLUMNS = (
    "matches", "mis_matches", "rep_matches", "n_count", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert", "strand", "q_name",
    "q_size", "q_beg", "q_end", "t_name", "t_size", "t_beg", "t_end", "block_count", "block_sizes", "q_starts", "t_starts",
)
_PSL_TEXT = ("strand", "q_name", "t_name", "block_sizes", "q_starts", "t_starts")


def _fields(lines: DataFrame, sep: str = "\t") -> DataFrame:
    return lines.select(F.split(F.regexp_replace("value", r"\r$", ""), sep).alias("f"))


def _at(i: int, kind: str = "string") -> Column:
    c = F.get("f", F.lit(i))
    return c if kind == "string" else c.try_cast(kind)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(ref_name, ref_len) of a FASTA index."""
    return _fields(spark.read.text(path)).select(_at(0).alias("ref_name"), _at(1, "bigint").alias("ref_len")).where("ref_len is not null")


def read_bed(spark: SparkSession, path: str, refs: list[str] | None = None) -> DataFrame:
    """(ref, beg, end, optional map): white-space separated; the first line of a file that starts with # names its
    columns from the fourth on. A file without one has the names that all headers of the path agree on (the parts of
    one table), else its columns are named by position."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__at"))
    words = F.split(F.trim(F.regexp_replace("value", "^#+", "")), r"\s+")
    heads = lines.where(F.col("value").startswith("#")).groupBy("__file").agg(F.min_by(F.slice(words, F.lit(4), F.greatest(F.size(words) - 3, F.lit(0))), "__at").alias("__names"))
    agreed = heads.select("__names").distinct().limit(2).collect()
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).join(broadcast_checked(heads), "__file", "left")
    f = body.select(F.split(F.regexp_replace("value", r"\r$", ""), r"\s+").alias("f"), "__names")
    by_place = F.transform(F.sequence(F.lit(4), F.greatest(F.size("f"), F.lit(4))), lambda i: F.concat(F.lit("column"), i.cast("string")))
    common = F.array(*[F.lit(n) for n in agreed[0][0]]) if len(agreed) == 1 and agreed[0][0] else by_place
    keys = F.coalesce("__names", common)
    n = F.greatest(F.size("f") - 3, F.lit(0))
    both = F.least(n, F.size(keys))
    optional = F.map_from_arrays(F.slice(keys, F.lit(1), both), F.slice("f", F.lit(4), both))
    out = f.select(_at(0).alias("ref"), _at(1, "bigint").alias("beg"), _at(2, "bigint").alias("end"), optional.alias("optional"))
    return out.where(F.col("ref").isin(refs)) if refs else out


def write_bed(df: DataFrame, path: str, columns: list[str]) -> None:
    """`#ref beg end columns...`, tab separated: a part file with the header line, then those of the rows."""
    names = ["ref", "beg", "end", *columns]
    df.sparkSession.createDataFrame([("#" + "\t".join(names),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])).write.mode("append").text(path)


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """The 12 columns and the tags; rows with fewer columns are left out."""
    f = _fields(spark.read.text(path)).where("size(f) >= 12")
    cols = [_at(i, "string" if c in _PAF_TEXT else "bigint").alias(c) for i, c in enumerate(PAF_COLUMNS)]
    return f.select(*cols, F.slice("f", F.lit(13), F.greatest(F.size("f") - 12, F.lit(0))).alias("tags"))


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(spark.read.text(path)).where("size(f) >= 21 and try_cast(f[0] as bigint) is not null")
    return f.select(*[_at(i, "string" if c in _PSL_TEXT else "bigint").alias(c) for i, c in enumerate(PSL_COLUMNS)])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, description, seq): records of any number of lines; the id is the header's first word."""
    rec = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    text = F.regexp_replace(F.regexp_replace("value", r"^>", ""), r"\r", "")
    parts = F.split(text, "\n", 2)
    head = F.get(parts, F.lit(0))
    return rec.select(
        F.regexp_extract(head, r"^(\S*)", 1).alias("seq_id"), F.regexp_extract(head, r"^\S*\s*(.*)$", 1).alias("description"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s+", "").alias("seq")
    )


def merge_fasta(frames: list[DataFrame]) -> DataFrame:
    """One table of several; of a repeated id the last table's sequence stands."""
    every = None
    for i, f in enumerate(frames):
        f = f.select("seq_id", "seq").withColumn("__n", F.lit(i))
        every = f if every is None else every.unionByName(f)
    return every.groupBy("seq_id").agg(F.max_by("seq", F.struct("__n", "seq")).alias("seq"))


def write_fasta(df: DataFrame, path: str, seq_id: str = "seq_id", seq: str = "seq", mode: str = "overwrite") -> None:
    df.select(F.concat(F.lit(">"), F.col(seq_id), F.lit("\n"), F.col(seq))).write.mode(mode).text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    """Four-line records of (seq_id, seq, description, qual)."""
    head = F.concat(F.lit("@"), F.col("seq_id"), F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), F.col("description"))).otherwise(F.lit("")))
    df.select(F.concat_ws("\n", head, F.col("seq"), F.lit("+"), F.col("qual"))).write.mode("overwrite").text(path)


def read_trf(spark: SparkSession, path: str) -> DataFrame:
    """Tandem repeats of `@name` blocks: (seq_id, beg, end, period, copies, motif_size, pct_match, pct_indel, score,
    a, c, g, t, entropy, motif, repeat); begin and end are shifted to count from 0."""
    blocks = spark.read.option("lineSep", "\n@").text(path).where(F.trim("value") != "")
    text = F.regexp_replace("value", r"^@|\r", "")
    lines = F.split(text, "\n")
    # the name is taken before the lines are exploded, else every line would search the whole block for it
    named = blocks.select(lines.alias("ls")).select(F.regexp_extract(F.get("ls", F.lit(0)), r"^(\S+)", 1).alias("seq_id"), F.slice("ls", F.lit(2), F.greatest(F.size("ls") - 1, F.lit(0))).alias("ls"))
    rows = named.select("seq_id", F.explode("ls").alias("l"))
    f = rows.where(F.trim("l") != "").select("seq_id", F.split(F.trim("l"), r"\s+").alias("f")).where("size(f) >= 15")
    kinds = ("bigint", "bigint", "int", "double", "int", "int", "int", "int", "int", "int", "int", "int", "double", "string", "string")
    names = ("beg", "end", "period", "copies", "motif_size", "pct_match", "pct_indel", "score", "a", "c", "g", "t", "entropy", "motif", "repeat")
    out = f.select("seq_id", *[_at(i, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))])
    return out.withColumn("beg", F.col("beg") - 1).withColumn("end", F.col("end") - 1)


def read_cell_svs(spark: SparkSession, path: str, refs: list[str] | None = None) -> DataFrame:
    """Single-cell calls of 15 white-space separated columns; a line starting with `chrom` is the header."""
    f = _fields(spark.read.text(path).where(~F.col("value").startswith("chrom") & (F.trim("value") != "")), r"\s+").where("size(f) >= 15")
    one, two = F.split(_at(8), "_"), F.split(_at(10), "_")
    out = f.select(
        F.regexp_replace(_at(0), "^chr", "").alias("ref"), _at(1, "bigint").alias("beg"), _at(2, "bigint").alias("end"), _at(3).alias("sample"), _at(4).alias("cell_id"),
        _at(5).alias("state"), _at(6, "double").alias("scalar"), _at(7, "int").alias("n_bins"), F.get(one, F.lit(0)).alias("sv_class"), F.get(one, F.lit(1)).alias("haplotype"),
        _at(9).alias("code1"), F.get(two, F.lit(0)).alias("sv_class2"), F.get(two, F.lit(1)).alias("haplotype2"), _at(11).alias("code2"), _at(12, "double").alias("llr_ref"),
        _at(13, "double").alias("llr_second"), _at(14, "double").alias("af"),
    )
    return out.where(F.col("ref").isin(refs)) if refs else out


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM text: flags as booleans, 0-based begin, end by the CIGAR's reference span, SA tag."""
    f = _fields(spark.read.text(path).where(~F.col("value").startswith("@"))).where("size(f) >= 11")
    tag = F.get(F.filter("f", lambda x: x.startswith("SA:Z:")), F.lit(0))
    raw = f.select(
        _at(0).alias("read_name"), _at(1, "int").alias("flag"), _at(2).alias("ref"), (_at(3, "bigint") - 1).alias("pos"), _at(4, "int").alias("mapq"), _at(5).alias("cigar"), _at(6).alias("mate_ref"),
        (_at(7, "bigint") - 1).alias("mate_pos"), _at(8, "bigint").alias("tlen"), _at(9).alias("seq"), _at(10).alias("qual"), F.substring(tag, 6, 1 << 30).alias("sa"),
    )
    return alignment_columns(raw)


def alignment_columns(raw: DataFrame) -> DataFrame:
    """The alignment table of records (read_name, flag, ref, pos from 0, mapq, cigar, mate_ref, mate_pos, tlen, seq,
    qual, sa)."""
    from ..functions.cigar import cigar_ops, ref_span

    bit = lambda n: F.col("flag").bitwiseAND(F.lit(n)) != 0
    return raw.select(
        "read_name", "ref", F.col("pos").alias("beg"), (F.col("pos") + ref_span(cigar_ops("cigar"))).alias("end"), "mapq", "cigar", "mate_ref", F.col("mate_pos").alias("mate_start"),
        F.col("tlen").alias("insert_size"), "seq", "qual", "sa", bit(1).alias("is_paired"), bit(2).alias("is_proper"), bit(4).alias("is_unmapped"), bit(8).alias("mate_unmapped"), bit(16).alias("is_reverse"),
        bit(32).alias("mate_reverse"), bit(64).alias("is_first"), bit(256).alias("is_secondary"), bit(1024).alias("is_dup"), bit(2048).alias("is_supplementary"),
    )


#: Lines beyond which a header is an error: it is read by the driver.
HEADER_LINES = 5_000_000


@dataclass
class VcfHeader:
    """What a VCF header declares; small by nature and kept on the driver."""

    source: str = ""
    reference: str = ""
    species: str = ""
    contigs: dict[str, int] = field(default_factory=dict)
    info: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    formats: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)

    def text(self, info_ids: list[str], format_ids: list[str], date: str) -> str:
        """Header lines up to the column line, contigs in order of their names."""
        out = ["##fileformat=VCFv4.2", f"##fileDate={date}", f"##source={self.source}", f"##reference={self.reference}"]
        out += [f"##contig=<ID={c},assembly={self.reference},length={n},species={self.species}>" for c, n in sorted(self.contigs.items())]
        out += ['##INFO=<ID={},Number={},Type={},Description="{}">'.format(i, *self.info[i]) for i in info_ids if i in self.info]
        out += ["##FORMAT=<ID={},Number={},Type={},Description={}>".format(i, *self.formats[i]) for i in format_ids if i in self.formats]
        cols = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"] + (["FORMAT", *self.samples] if self.samples else [])
        return "\n".join([*out, "\t".join(cols)])


def read_vcf_header(spark: SparkSession, path: str) -> VcfHeader:
    import re

    h = VcfHeader()
    lines = spark.read.text(path).where(F.col("value").startswith("#"))
    for (line,) in fixed_rows(lines, HEADER_LINES):
        m = re.match(r"##(\w+)=(.*)", line)
        ids = re.match(r"##\w+=<ID=([^,>]+)(?:,Number=([^,]*),Type=([^,]*),Description=\"?(.*?)\"?)?>?$", line)
        if line.startswith("#CHROM"):
            h.samples = line.rstrip().split("\t")[9:]
        elif m and m[1] in ("source", "reference"):
            setattr(h, m[1], m[2])
        elif m and m[1] == "contig":
            name, size = re.search(r"ID=([^,>]+)", line), re.search(r"length=(\d+)", line)
            h.contigs[name[1]] = int(size[1]) if size else 0
        elif m and ids and m[1] in ("INFO", "FORMAT"):
            (h.info if m[1] == "INFO" else h.formats)[ids[1]] = (ids[2] or "", ids[3] or "", ids[4] or "")
    return h


def info_map(info: Column) -> Column:
    """INFO text -> map; a flag's value is `true`; `.` and empty give an empty map."""
    items = F.filter(F.split(F.coalesce(info, F.lit("")), ";"), lambda x: ~x.isin("", "."))
    pair = F.transform(items, lambda x: F.struct(F.get(F.split(x, "=", 2), F.lit(0)).alias("k"), F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit("true")).alias("v")))
    # of a repeated key the first statement stands
    fresh = F.filter(pair, lambda p, i: F.array_position(F.transform(pair, lambda q: q["k"]), p["k"]) == i + 1)
    return F.map_from_entries(fresh)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info map, format, genotypes array)."""
    f = _fields(spark.read.text(path).where(~F.col("value").startswith("#"))).where("size(f) >= 8")
    return f.select(
        _at(0).alias("chrom"), _at(1, "bigint").alias("pos"), _at(2).alias("id"), _at(3).alias("ref"), _at(4).alias("alt"), _at(5).alias("qual"), _at(6).alias("filter"), info_map(_at(7)).alias("info"),
        F.split(_at(8), ":").alias("format"), F.slice("f", F.lit(10), F.greatest(F.size("f") - 9, F.lit(0))).alias("genotypes"),
    )


def build_info(info: Column, ids: list[str]) -> Column:
    """INFO text in the order of ids: absent, `None` and `false` are left out, `true` is a flag."""
    one = lambda k: F.when(info[k] == "true", F.lit(k)).when(info[k].isNotNull() & ~info[k].isin("false", "None"), F.concat(F.lit(f"{k}="), info[k]))
    text = F.concat_ws(";", *[one(k) for k in ids])
    return F.when(text == "", ".").otherwise(text)


def pos_interval(pos: Column, cipos: Column) -> Column:
    """struct(beg, end) of a position and its `low,high` confidence offsets; the position alone without them."""
    p = F.split(cipos, ",")
    off = lambda i: F.coalesce(F.get(p, F.lit(i)).try_cast("bigint"), F.lit(0))
    return F.struct((pos + off(0)).alias("beg"), (pos + off(1)).alias("end"))


def write_vcf(df: DataFrame, path: str, header: VcfHeader, info_ids: list[str], date: str, spark: SparkSession | None = None, one_file: bool = False) -> None:
    """Body in order of (chromosome as text, position) over range-partitioned part files, preceded by a part of the
    header; every line of the body ends in a tab. df: chrom, pos, id, ref, alt, qual, filter, info map. With one_file
    the parts are joined, header first, to one VCF at `path`: its bytes stream through the driver."""
    spark = spark or df.sparkSession
    if one_file:
        parts = path + ".parts"
        write_vcf(df, parts, header, info_ids, date, spark)
        join_parts(spark, [parts + "/header", parts + "/body"], path)
        return
    cols = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("chrom", "pos", "id", "ref", "alt", "qual", "filter")]
    body = df.orderBy("chrom", "pos").select(F.concat(F.concat_ws("\t", *cols, build_info(F.col("info"), info_ids)), F.lit("\t")).alias("value"))
    spark.createDataFrame([(header.text(info_ids, [], date),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/header")
    body.write.mode("overwrite").text(path + "/body")


def join_parts(spark: SparkSession, folders: list[str], path: str) -> None:
    """The part files of the folders, in order of their names, as one file; the folders are deleted with the one that
    holds them."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    out = fs.create(at(path), True)
    try:
        for folder in folders:
            for name in sorted(s.getPath().getName() for s in fs.listStatus(at(folder)) if s.getPath().getName().startswith("part-")):
                part = fs.open(at(f"{folder}/{name}"))
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
                part.close()
    finally:
        out.close()
    fs.delete(at(folders[0]).getParent(), True)


def reads_to_paf(reads: DataFrame) -> DataFrame:
    """Mapped alignments as PAF rows; matches and block length are unknown and 0, the target length is the aligned
    one."""
    from ..functions.cigar import cigar_ops, left_clip, query_span, read_length, ref_span

    ops = cigar_ops("cigar")
    return reads.where(~F.col("is_unmapped")).select(
        F.col("read_name").alias("q_name"), read_length(ops).cast("bigint").alias("q_len"), left_clip(ops).cast("bigint").alias("q_beg"), (left_clip(ops) + query_span(ops)).cast("bigint").alias("q_end"),
        F.when(F.col("is_reverse"), "-").otherwise("+").alias("strand"), F.col("ref").alias("t_name"), ref_span(ops).cast("bigint").alias("t_len"), F.col("beg").alias("t_beg"), F.col("end").alias("t_end"),
        F.lit(0).cast("bigint").alias("matches"), F.lit(0).cast("bigint").alias("block_len"), F.col("mapq").cast("bigint").alias("mapq"),
    )


def reads_to_fastq(reads: DataFrame) -> DataFrame:
    """Reads as sequenced: those on the reverse strand are reverse-complemented, their qualities reversed."""
    from ..functions.sequences import reverse_complement

    rev = F.col("is_reverse")
    return reads.select(
        F.col("read_name").alias("seq_id"), F.when(rev, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.lit("").alias("description"), F.when(rev, F.reverse("qual")).otherwise(F.col("qual")).alias("qual")
    )


def write_annotator_input(events: DataFrame, path: str) -> None:
    """ref, beg, end, 0, 0, `comments: name` as an external gene annotator reads them."""
    events.select(F.concat_ws("\t", "ref", F.col("beg").cast("string"), F.col("end").cast("string"), F.lit("0"), F.lit("0"), F.concat(F.lit("comments: "), F.col("name")))).write.mode("overwrite").text(path)


def read_annotator_output(spark: SparkSession, path: str) -> DataFrame:
    """(name, region, gene) from the white-space columns 9, 1 and 2 of an annotator's result."""
    f = _fields(spark.read.text(path), r"\s+").where("size(f) >= 9")
    return f.select(_at(8).alias("name"), _at(0).alias("region"), _at(1).alias("gene"))


def reads_to_bed(reads: DataFrame) -> DataFrame:
    """BED rows of alignments, one per block of a spliced one: (ref, beg, end, name, score, strand)."""
    from ..functions.cigar import blocks, cigar_ops

    rows = blocks(reads.where(~F.col("is_unmapped")).withColumn("ops", cigar_ops("cigar")), "ops", "beg")
    return rows.select("ref", F.col("block_beg").alias("beg"), F.col("block_end").alias("end"), F.col("read_name").alias("name"), F.col("mapq").alias("score"), F.when(F.col("is_reverse"), "-").otherwise("+").alias("strand"))


def insertions_to_fasta(variants: DataFrame, itype: str, fam: str) -> DataFrame:
    """(seq_id, seq): the inserted sequences (INFO INSEQ) of variants of a type and family, named chrom_pos_fam."""
    i = F.col("info")
    return variants.where((i["ITYPE"] == itype) & (i["FAM"] == fam) & i["INSEQ"].isNotNull()).select(F.concat_ws("_", "chrom", F.col("pos").cast("string"), F.lit(fam)).alias("seq_id"), i["INSEQ"].alias("seq"))


def insertion_intervals(variants: DataFrame) -> DataFrame:
    """(chrom, beg, end, kind): confidence intervals of insertions, kind being ITYPE or ITYPE-FAM."""
    i = F.col("info")
    at = pos_interval(F.col("pos"), i["CIPOS"])
    return variants.select("chrom", at["beg"].alias("beg"), at["end"].alias("end"), F.concat_ws("-", i["ITYPE"], i["FAM"]).alias("kind"))


def hits_as_sa(hits: DataFrame, side: Column) -> DataFrame:
    """(q_name, sa): PSL hits of clipped sequences as SA text, the clipped part matching, the rest hard-clipped."""
    n, rest = F.col("q_end") - F.col("q_beg"), F.col("q_size") - (F.col("q_end") - F.col("q_beg"))
    cig = F.when(side == "left", F.concat(n, F.lit("M"), rest, F.lit("H"))).otherwise(F.concat(rest, F.lit("H"), n, F.lit("M")))
    one = F.concat_ws(",", "t_name", F.col("t_beg").cast("string"), "strand", cig, F.lit("0"), F.lit("0"))
    return hits.withColumn("__one", F.concat(one, F.lit(";"))).groupBy("q_name").agg(F.array_join(F.array_sort(F.collect_list("__one")), "").alias("sa"))


def calls_to_vcf(calls: DataFrame, info: dict[str, Column], alt: str = "<INS>") -> DataFrame:
    """VCF rows (chrom, pos, id, ref, alt, qual, filter, info map) of calls (ref, mean_pos, failed_filters...); the
    filter text lists the failures, or PASS; INFO entries of null are left out."""
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in info.items()]), lambda p: p["v"].isNotNull())
    failed = F.array_join("failed_filters", ",")
    return calls.select(
        F.col("ref").alias("chrom"), F.col("mean_pos").alias("pos"), F.lit(".").alias("id"), F.lit("N").alias("ref"), F.lit(alt).alias("alt"), F.lit(".").alias("qual"),
        F.when(failed == "", "PASS").otherwise(failed).alias("filter"), F.map_from_entries(pairs).alias("info"),
    )
