"""The test tables in the shapes that the interval, read, sequence and single-cell operators take, in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contigs import with_contig
from ..operators.hotkeys import newest_per_id
from ..session import settle, table

KNOWN_SQL = """known AS (SELECT lower(regexp_replace(n, '^\\s+|\\s+$', '', 'g')) AS nk, min(ref_name) AS contig FROM (
  SELECT ref_name, unnest([ref_name, alias_name, accession]) AS n FROM contigs) WHERE n IS NOT NULL GROUP BY 1)"""
_KEY = "lower(regexp_replace(ref_name, '^\\s+|\\s+$', '', 'g'))"

EV_SQL = f"""{KNOWN_SQL}, ev0 AS (SELECT e.*, contig, row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) AS rn
  FROM sv_events e JOIN known ON {_KEY} = nk WHERE event_id IS NOT NULL),
ev AS (SELECT event_id, contig AS ref, beg, end_pos, end_pos - beg AS len, read_name, coalesce(sv_type, 'OTHER') AS sv_type, sample_name,
  CASE WHEN sample_name IS NULL THEN NULL WHEN CAST(right(sample_name, 1) AS INTEGER) % 3 = 0 THEN 'NORMAL' ELSE 'TUMOUR' END AS role,
  is_reverse, is_dup, mapq FROM ev0 WHERE rn = 1 AND beg IS NOT NULL AND end_pos >= beg)"""

AN_SQL = f"""an AS (SELECT row_id, track_id, contig AS r_ref, beg AS r_beg, end_pos AS r_end, feat_name, feat_family, strand
  FROM bed_regions JOIN (SELECT * FROM known) k ON {_KEY} = nk WHERE beg >= 0 AND end_pos > beg)"""

LI_SQL = """li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity AS INTEGER) AS qty,
  CAST(l_linenumber * 3 AS VARCHAR) || 'S' || CAST(CAST(l_quantity AS INTEGER) + 10 AS VARCHAR) || 'M' || CAST(l_partkey % 90 + 1 AS VARCHAR) || 'I' ||
  CAST(l_suppkey % 80 + 5 AS VARCHAR) || 'M' || CAST(l_orderkey % 70 + 1 AS VARCHAR) || 'D' || CAST(l_linenumber + 7 AS VARCHAR) || 'M' AS cigar,
  CASE WHEN l_linenumber % 2 = 1 THEN '-' ELSE '+' END AS strand FROM lineitem)"""

SQ_SQL = """sq AS (SELECT rec_no, upper(regexp_replace(seq, '\\s+', '', 'g')) AS seq FROM fasta_seqs WHERE seq IS NOT NULL)"""

CELL_SQL = """cs AS (SELECT event_id, CAST(user_id % 50 AS BIGINT) AS cell_id, event_type AS ref, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS beg,
  CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) + CAST(floor(value) AS BIGINT) + 1 AS end_pos,
  ['del', 'dup', 'idup', 'complex', 'inv'][event_id % 5 + 1] AS sv_class, CASE event_id % 3 WHEN 0 THEN 'h1' WHEN 1 THEN 'h2' END AS haplotype, (event_id % 10) / 10.0 AS af FROM events)"""
CELL_LENGTH = 60_000_000


#: The columns of an event beside its id.
EVENT = ("ref", "beg", "end", "len", "read_name", "sv_type", "sample_name", "is_reverse", "is_dup", "mapq", "role")
#: Those of its place, for plans that read no more.
PLACE = ("ref", "beg", "end")


def events(spark: SparkSession, sf: str, columns: tuple[str, ...] = EVENT) -> DataFrame:
    """The named columns of each event's newest row on a known contig, with a begin."""
    source = {"end": "end_pos", "len": "end_pos", "role": "sample_name"}
    kept = sorted({source.get(c, c) for c in columns} | {"ref", "beg", "end_pos"})
    raw = table(spark, sf, "sv_events").select("event_id", "ref_name", "loaded_at", *[c for c in kept if c != "ref"])
    raw = with_contig(raw, table(spark, sf, "contigs"), "ref_name", "ref")
    one = newest_per_id(raw, "event_id", "loaded_at", {c: F.col(c) for c in kept}).withColumnRenamed("__id", "event_id")
    role = F.when(F.col("sample_name").isNull(), F.lit(None).cast("string")).when(F.right("sample_name", F.lit(1)).cast("int") % 3 == 0, "NORMAL").otherwise("TUMOUR")
    made = {"end": F.col("end_pos"), "len": F.col("end_pos") - F.col("beg"), "sv_type": F.coalesce("sv_type", F.lit("OTHER")), "role": role}
    return one.where("beg is not null and end_pos >= beg").select("event_id", *[made.get(c, F.col(c)).alias(c) for c in columns])


def settled_events(spark: SparkSession, sf: str, kind: str | None = None, columns: tuple[str, ...] = EVENT) -> DataFrame:
    """`events` of one type or all as a settled table, for plans that read them more than once."""
    ev = events(spark, sf, columns if kind is None else tuple(dict.fromkeys((*columns, "sv_type"))))
    return settle(ev if kind is None else ev.where(F.col("sv_type") == kind))


def features(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "bed_regions").where("beg >= 0 and end_pos > beg").select("row_id", "track_id", "ref_name", "beg", "end_pos", "feat_name", "feat_family", "strand")
    got = with_contig(raw, table(spark, sf, "contigs"), "ref_name", "r_ref")
    return got.select("row_id", "track_id", "r_ref", F.col("beg").alias("r_beg"), F.col("end_pos").alias("r_end"), "feat_name", "feat_family", "strand")


def cigars(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("qty"))
    text = F.expr("concat(l_linenumber * 3, 'S', qty + 10, 'M', l_partkey % 90 + 1, 'I', l_suppkey % 80 + 5, 'M', l_orderkey % 70 + 1, 'D', l_linenumber + 7, 'M')")
    return li.withColumn("cigar", text).withColumn("strand", F.expr("if(l_linenumber % 2 = 1, '-', '+')"))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "fasta_seqs").where("seq is not null").select("rec_no", F.upper(F.regexp_replace("seq", r"\s+", "")).alias("seq"))


def cell_svs(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"), "value")
    kinds = F.array(*[F.lit(x) for x in ("del", "dup", "idup", "complex", "inv")])
    beg = F.col("s") - 1704067200
    return ev.select(
        "event_id", (F.col("user_id") % 50).alias("cell_id"), F.col("event_type").alias("ref"), beg.alias("beg"), (beg + F.floor("value") + 1).alias("end"),
        F.get(kinds, (F.col("event_id") % 5).cast("int")).alias("sv_class"), F.when(F.col("event_id") % 3 == 0, "h1").when(F.col("event_id") % 3 == 1, "h2").alias("haplotype"), ((F.col("event_id") % 10) / 10.0).alias("af"),
    )


def haplotypes(spark: SparkSession, sf: str) -> DataFrame:
    """(seq_id, pos, state): the sign of each component of a vector."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("seq_id"), F.posexplode("embedding").alias("p", "x"))
    return v.select("seq_id", (F.col("p") + 1).alias("pos"), F.expr("case when x > 0 then 1 when x < 0 then 2 else 0 end").alias("state"))


HAP_SQL = """hp AS (SELECT vec_id AS seq_id, CAST(i AS INTEGER) AS pos, CASE WHEN embedding[i] > 0 THEN 1 WHEN embedding[i] < 0 THEN 2 ELSE 0 END AS state
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
