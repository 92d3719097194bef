"""Queries p2 to p5 over the project's tables, with the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.contigs import with_contig
from ..operators.hotkeys import hot_keys, key_profile
from ..operators.periods import periods_and_gaps
from ..operators.widen import other_attributes, widen
from ..session import fixed_rows, table
from ..sources.records import parse_runs

Query = Callable[[SparkSession, str], DataFrame]

_KNOWN = """known AS (SELECT lower(regexp_replace(n, '^\\s+|\\s+$', '', 'g')) AS nk, min(ref_name) AS contig FROM (
  SELECT ref_name, unnest([ref_name, alias_name, accession]) AS n FROM contigs) WHERE n IS NOT NULL GROUP BY 1)"""


def _key(c: str) -> str:
    return f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"


def family(c: str = "fam"):
    """The family as upper-case text without `FAM=`; null where there is none."""
    strip = r"^\s+|\s+$"
    f = F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), strip, ""), r"(?i)^FAM=\s*", ""), strip, ""))
    return F.when(~f.isin("", ".", "NONE"), f)


FAMILY_SQL = "nullif(nullif(nullif(upper(regexp_replace(regexp_replace(regexp_replace(fam, '^\\s+|\\s+$', '', 'g'), '^FAM=\\s*', '', 'i'), '^\\s+|\\s+$', '', 'g')), ''), '.'), 'NONE')"

FOUND_ATTRS = [("ITYPE", "String"), ("FAM", "String"), ("LEN", "Integer"), ("NBTOTAL", "Integer"), ("FULL", "Flag")]
FOUND_DEFAULTS = {"ITYPE": "", "FAM": "", "LEN": -1, "NBTOTAL": -1, "FULL": 0}


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    wide = widen(table(spark, sf, "vcf_info"), FOUND_ATTRS, defaults=FOUND_DEFAULTS)
    return wide.select(
        "variant_id", F.col("ITYPE").alias("itype"), F.col("FAM").alias("fam"), F.col("LEN").alias("len_bp"), F.col("NBTOTAL").alias("nbtotal"), F.col("FULL").alias("is_full")
    )


def _declared(spark: SparkSession, sf: str) -> list[tuple[str, str]]:
    """Every declared attribute. info_defs is a fixed table of 17 rows, so its names may shape the plan."""
    return sorted((r[0].strip().upper(), r[1]) for r in fixed_rows(table(spark, sf, "info_defs").select("attr_name", "value_type")))


def p2_wide(spark: SparkSession, sf: str) -> DataFrame:
    """A typed column for every declared attribute; p2_wide_all has the others too."""
    defs = _declared(spark, sf)
    wide = widen(table(spark, sf, "vcf_info"), defs)
    return wide.select("variant_id", *[F.col(n).alias(f"a_{n.lower()}") for n, _ in defs])


def p2_wide_all(spark: SparkSession, sf: str) -> DataFrame:
    """p2_wide, and in `others` the attributes listed nowhere; null where a variant has none."""
    others = other_attributes(table(spark, sf, "vcf_info"), _declared(spark, sf))
    return p2_wide(spark, sf).join(others, "variant_id", "left")


_USABLE = {
    "String": "CASE WHEN upper(v) NOT IN ('', '.', 'NA', 'N/A', 'NONE', 'NULL', 'NAN') THEN v END",
    "Integer": "CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN v END",
    "Float": "CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN v END",
    "Flag": "CASE WHEN lower(v) IN ('false', '0') THEN '0' ELSE '1' END",
}
_CAST = {"String": "{}", "Integer": "try_cast({} AS BIGINT)", "Float": "try_cast({} AS DOUBLE)", "Flag": "try_cast({} AS INTEGER)"}


def _wide_sql(attrs: list[tuple[str, str]], cols: str) -> str:
    picks = ", ".join(
        _CAST[t].format(f"arg_max(u, (loaded_at, row_no)) FILTER (WHERE a = '{n}' AND u IS NOT NULL)") + f" AS c_{n.lower()}" for n, t in attrs
    )
    case = " ".join(f"WHEN a = '{n}' THEN {_USABLE[t]}" for n, t in attrs)
    return f"""WITH r AS (SELECT variant_id, row_no, loaded_at, upper(regexp_replace(attr_name, '^\\s+|\\s+$', '', 'g')) AS a,
  regexp_replace(attr_value, '^\\s+|\\s+$', '', 'g') AS v FROM vcf_info),
s AS (SELECT *, CASE {case} END AS u FROM r),
w AS (SELECT variant_id, {picks} FROM s GROUP BY variant_id)
SELECT {cols} FROM w"""


ALL_ATTRS = [
    ("CHROM", "String"), ("POS", "Integer"), ("VTYPE", "String"), ("ITYPE", "String"), ("MECHANISM", "String"), ("FAM", "String"),
    ("SUBFAM", "String"), ("STRAND", "String"), ("NBTOTAL", "Integer"), ("NBTUMOR", "Integer"), ("NBNORMAL", "Integer"), ("LEN", "Integer"),
    ("CV", "Float"), ("TDLEN", "Integer"), ("REGION", "String"), ("FULL", "Flag"), ("POLYA", "Flag"),
]


def _bed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "bed_regions").where("beg >= 0 and end_pos > beg").select("track_id", "ref_name", "beg", "end_pos")
    return with_contig(rows, table(spark, sf, "contigs"), "ref_name", "ref_name")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return periods_and_gaps(_bed(spark, sf), ["track_id", "ref_name"], "beg", "end_pos")


def p3_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Covered and uncovered bases per track, from the periods and gaps."""
    return (
        p3_found(spark, sf)
        .groupBy("track_id")
        .agg(
            F.count_if(F.col("kind") == "period").alias("n_periods"),
            F.sum(F.expr("if(kind = 'period', end_pos - beg, 0)")).alias("covered_bp"),
            F.count_if(F.col("kind") == "gap").alias("n_gaps"),
            F.sum(F.expr("if(kind = 'gap', end_pos - beg, 0)")).alias("gap_bp"),
        )
    )


_PERIODS_SQL = f"""WITH {_KNOWN},
b AS (SELECT track_id, contig AS ref_name, beg, end_pos FROM bed_regions JOIN known ON {_key('ref_name')} = nk WHERE beg >= 0 AND end_pos > beg),
m AS (SELECT *, max(end_pos) OVER (PARTITION BY track_id, ref_name ORDER BY beg, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR beg > pe THEN 1 ELSE 0 END) OVER (PARTITION BY track_id, ref_name ORDER BY beg, end_pos ROWS UNBOUNDED PRECEDING) AS isle FROM m),
p AS (SELECT track_id, ref_name, isle, min(beg) AS beg, max(end_pos) AS end_pos FROM i GROUP BY 1, 2, 3),
g AS (SELECT track_id, ref_name, end_pos AS beg, lead(beg) OVER (PARTITION BY track_id, ref_name ORDER BY beg) AS end_pos FROM p),
f AS (SELECT track_id, ref_name, 'period' AS kind, beg, end_pos FROM p
  UNION ALL SELECT track_id, ref_name, 'gap', beg, end_pos FROM g WHERE end_pos IS NOT NULL)
"""

HOT_SHARE = 0.05


def _contig_events(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "sv_events").select("event_id", "ref_name", "beg", "end_pos", "read_name", "mapq", "loaded_at")
    return with_contig(ev, table(spark, sf, "contigs"), "ref_name", "contig")


def _family_calls(spark: SparkSession, sf: str) -> DataFrame:
    calls = table(spark, sf, "ins_calls").select("call_id", "fam", "len_bp", "sample_name", "loaded_at")
    return calls.withColumn("family", family()).withColumn("size", F.expr("if(len_bp between 1 and 1000000, len_bp, null)"))


def p4_key_profile(spark: SparkSession, sf: str) -> DataFrame:
    """One row per contig and per family: ids, distinct reads or samples, bounds and exact median."""
    c = F.col
    of_events = key_profile(_contig_events(spark, sf), "event_id", "loaded_at", c("contig"), c("read_name"), c("beg"), c("end_pos"), c("mapq").cast("bigint"))
    of_calls = key_profile(_family_calls(spark, sf), "call_id", "loaded_at", c("family"), c("sample_name"), c("size"), c("size"), c("size"))
    named = lambda df, name: df.select(F.lit(name).alias("table_name"), "*")
    return named(of_events, "sv_events").unionByName(named(of_calls, "ins_calls"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    of_events = hot_keys(_contig_events(spark, sf), "event_id", "loaded_at", c("contig"), c("mapq").cast("bigint"), HOT_SHARE)
    of_calls = hot_keys(_family_calls(spark, sf), "call_id", "loaded_at", c("family"), c("size"), HOT_SHARE)
    return of_events.select(F.lit("sv_events").alias("table_name"), "hot_key").unionByName(of_calls.select(F.lit("ins_calls").alias("table_name"), "hot_key"))


_P4_IDS = f"""WITH {_KNOWN},
e0 AS (SELECT event_id, contig, beg, end_pos, read_name, mapq, row_number() OVER (PARTITION BY event_id ORDER BY loaded_at DESC) AS rn
  FROM sv_events JOIN known ON {_key('ref_name')} = nk WHERE event_id IS NOT NULL),
e AS (SELECT * FROM e0 WHERE rn = 1),
c0 AS (SELECT call_id, {FAMILY_SQL} AS family, sample_name, CASE WHEN len_bp BETWEEN 1 AND 1000000 THEN len_bp END AS v, loaded_at FROM ins_calls WHERE call_id IS NOT NULL),
c1 AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY loaded_at DESC) AS rn FROM c0 WHERE family IS NOT NULL),
c AS (SELECT * FROM c1 WHERE rn = 1)
"""
_P4_SQL = (
    _P4_IDS
    + """SELECT 'sv_events' AS table_name, contig AS hot_key, count(*) AS n_ids, count(DISTINCT read_name) AS n_distinct,
  min(beg) AS lo, max(end_pos) AS hi, CAST(quantile_disc(mapq, 0.5) AS BIGINT) AS q50 FROM e GROUP BY contig
UNION ALL SELECT 'ins_calls', family, count(*), count(DISTINCT sample_name), min(v), max(v), quantile_disc(v, 0.5) FROM c GROUP BY family"""
)


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a file in runs, parsed as one text each: the grammar goes on at record starts behind an error."""
    return parse_runs(table(spark, sf, "raw_lines"), table(spark, sf, "contigs"), "line_id", "fmt", "raw_line", "file_name", "line_no")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _records(spark, sf).where("reason is not null").select("line_id", "reason")


def p5_records(spark: SparkSession, sf: str) -> DataFrame:
    """The valid records, typed."""
    return _records(spark, sf).where("reason is null").select("line_id", "fmt", "ref_field", "beg", "end_pos", "name", "family", "strand", "q_name", "q_beg", "q_end", "mapq")


PROBLEMS: dict[str, Query] = {
    "p2_found": p2_found,
    "p2_wide": p2_wide,
    "p2_wide_all": p2_wide_all,
    "p3_found": p3_found,
    "p3_coverage": p3_coverage,
    "p4_found": p4_found,
    "p4_key_profile": p4_key_profile,
    "p5_found": p5_found,
    "p5_records": p5_records,
}

_F = "(?:\"(?:[^\"]|\"\")*\"|[^\"\\t][^\\t]*|)"  # a well-formed field of a line
_P5_SQL = f"""WITH l AS (SELECT line_id, lower(trim(fmt)) AS fmt, regexp_replace(raw_line, '\\r$', '') AS t FROM raw_lines
  WHERE raw_line IS NOT NULL AND length(regexp_replace(raw_line, '\\s', '', 'g')) > 0 AND NOT regexp_matches(raw_line, '^(#|track|browser)')),
q AS (SELECT *, regexp_full_match(t, '{_F}(\\t{_F})*', 's') AS ok FROM l WHERE fmt IN ('bed', 'paf')),
s AS (SELECT *, CASE WHEN ok THEN regexp_extract_all(chr(9) || t, '\\t({_F})', 1, 's') ELSE [] END AS raw FROM q),
f AS (SELECT line_id, fmt, ok, list_transform(raw, lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS a FROM s),
k AS (SELECT DISTINCT unnest([ref_name, alias_name, accession]) AS n FROM contigs),
v AS (SELECT *, CASE WHEN fmt = 'bed' THEN [a[2], a[3]] ELSE a[2:4] || a[7:12] END AS nums,
  CASE WHEN fmt = 'bed' THEN a[1] ELSE a[6] END AS ref, CASE WHEN fmt = 'bed' THEN a[4] ELSE a[6] END AS nm,
  CASE WHEN fmt = 'bed' THEN a[6] ELSE a[5] END AS strand FROM f),
n AS (SELECT *, list_transform(nums, lambda x: CASE WHEN regexp_full_match(x, '[0-9]{{1,18}}') THEN CAST(x AS BIGINT) END) AS i FROM v),
r AS (SELECT line_id, fmt, a, i, CASE WHEN NOT ok THEN 'quoting'
  WHEN (fmt = 'bed' AND len(a) <> 6) OR (fmt = 'paf' AND len(a) < 12) THEN 'columns'
  WHEN len(list_filter(i, lambda x: x IS NULL)) > 0 THEN 'number'
  WHEN fmt = 'bed' AND i[1] >= i[2] THEN 'range'
  WHEN fmt = 'paf' AND (i[2] >= i[3] OR i[3] > i[1] OR i[5] >= i[6] OR i[6] > i[4] OR i[7] > i[8] OR i[9] > 255) THEN 'range'
  WHEN strand NOT IN ('+', '-') AND NOT (fmt = 'bed' AND strand = '.') THEN 'strand'
  WHEN regexp_full_match(nm, '\\s*') OR regexp_matches(nm, '[^\\t\\x20-\\x7e]') THEN 'name'
  WHEN ref NOT IN (SELECT n FROM k WHERE n IS NOT NULL) THEN 'ref' END AS reason FROM n)
"""

PROBLEM_SQL: dict[str, str] = {
    "p2_found": _wide_sql(FOUND_ATTRS, "variant_id, coalesce(c_itype, '') AS itype, coalesce(c_fam, '') AS fam, coalesce(c_len, -1) AS len_bp, coalesce(c_nbtotal, -1) AS nbtotal, coalesce(c_full, 0) AS is_full"),
    "p2_wide": _wide_sql(ALL_ATTRS, "variant_id, " + ", ".join(f"c_{n.lower()} AS a_{n.lower()}" for n, _ in ALL_ATTRS)),
    "p3_found": _PERIODS_SQL + "SELECT * FROM f",
    "p3_coverage": _PERIODS_SQL
    + """SELECT track_id, count(*) FILTER (kind = 'period') AS n_periods, CAST(sum(CASE WHEN kind = 'period' THEN end_pos - beg ELSE 0 END) AS BIGINT) AS covered_bp,
  count(*) FILTER (kind = 'gap') AS n_gaps, CAST(sum(CASE WHEN kind = 'gap' THEN end_pos - beg ELSE 0 END) AS BIGINT) AS gap_bp FROM f GROUP BY track_id""",
    "p4_found": _P4_IDS
    + f"""SELECT 'sv_events' AS table_name, contig AS hot_key FROM e GROUP BY contig HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM e)
UNION ALL SELECT 'ins_calls', family FROM c GROUP BY family HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM c)""",
    "p4_key_profile": _P4_SQL,
    "p5_found": _P5_SQL + "SELECT line_id, reason FROM r WHERE reason IS NOT NULL",
    "p5_records": _P5_SQL
    + """SELECT line_id, fmt, CASE WHEN fmt = 'bed' THEN a[1] ELSE a[6] END AS ref_field, CASE WHEN fmt = 'bed' THEN i[1] ELSE i[5] END AS beg,
  CASE WHEN fmt = 'bed' THEN i[2] ELSE i[6] END AS end_pos, CASE WHEN fmt = 'bed' THEN a[4] ELSE a[6] END AS name, CASE WHEN fmt = 'bed' THEN a[5] END AS family,
  CASE WHEN fmt = 'bed' THEN a[6] ELSE a[5] END AS strand, CASE WHEN fmt = 'paf' THEN a[1] END AS q_name, CASE WHEN fmt = 'paf' THEN i[2] END AS q_beg,
  CASE WHEN fmt = 'paf' THEN i[3] END AS q_end, CASE WHEN fmt = 'paf' THEN i[9] END AS mapq FROM r WHERE reason IS NULL""",
}
