"""Queries q01 to q50 and beyond: one per operator of the interval engine, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chains, cigar, sequences
from ..operators import aggregates as ag
from ..operators import annotation as an
from ..operators import clustering as cl
from ..operators import depth as dp
from ..operators import filters as fl
from ..operators import haplotype as hp
from ..operators import intervals as iv
from ..operators import singlecell as sc
from ..operators.ordered import place
from ..session import broadcast_checked, settle, table
from ..sources.formats import info_map
from . import tables as tb
from .tables import AN_SQL, CELL_LENGTH, CELL_SQL, EV_SQL, HAP_SQL, KNOWN_SQL, LI_SQL, SQ_SQL

Query = Callable[[SparkSession, str], DataFrame]
Q: dict[str, Query] = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# ---- bins and depth


@query("SELECT ref_name AS ref, b AS beg, least(b + 1000000, ref_len) AS end_pos FROM (SELECT ref_name, ref_len, unnest(range(0, ref_len, 1000000)) AS b FROM contigs)")
def q01_genomic_bins(spark, sf):
    return iv.genomic_bins(table(spark, sf, "contigs"), 1_000_000).withColumnRenamed("end", "end_pos")


@query(f"""WITH {EV_SQL}, b AS (SELECT ref, is_reverse, unnest(range(beg // 10000, end_pos // 10000 + 1)) AS bin FROM ev WHERE mapq >= 20 AND NOT coalesce(is_dup, false))
SELECT ref, bin, count(*) AS tdp, count(*) FILTER (NOT is_reverse) AS wdp, count(*) FILTER (is_reverse) AS cdp FROM b GROUP BY 1, 2""")
def q02_depth_by_bin(spark, sf):
    return dp.read_depth(dp.usable(tb.events(spark, sf), 20), 10_000)


@query(f"""WITH {EV_SQL}, b AS (SELECT sample_name, ref, unnest(range(beg // 1000000, end_pos // 1000000 + 1)) AS bin FROM ev WHERE mapq >= 20 AND NOT coalesce(is_dup, false) AND sample_name IS NOT NULL),
d AS (SELECT sample_name, ref, bin, count(*) AS tdp FROM b GROUP BY 1, 2, 3)
SELECT ref, bin, count(*) AS n, round(avg(tdp), 6) AS tdp_mean, round(stddev_pop(tdp), 6) AS tdp_sd FROM d GROUP BY 1, 2""")
def q03_depth_consensus(spark, sf):
    d = dp.read_depth(dp.usable(tb.events(spark, sf), 20).where("sample_name is not null"), 1_000_000, ["sample_name"])
    return dp.consensus_depth(d, ["ref", "bin"]).select("ref", "bin", "n", r6("tdp_mean", "tdp_mean"), r6("tdp_sd", "tdp_sd"))


# ---- interval joins

_PAIR = "ev.ref = an.r_ref AND ev.beg <= an.r_end AND an.r_beg <= ev.end_pos"
_SHARED = "least(end_pos, r_end) - greatest(beg, r_beg)"


@query(f"WITH {EV_SQL}, {AN_SQL} SELECT event_id, row_id, {_SHARED} + 1 AS overlap_bp FROM ev JOIN an ON {_PAIR}")
def q04_overlap_join(spark, sf):
    got = iv.range_join(tb.settled_events(spark, sf, columns=tb.PLACE).select("event_id", "ref", "beg", "end"), tb.features(spark, sf).select("row_id", "r_ref", "r_beg", "r_end"))
    return got.select("event_id", "row_id", iv.overlap_bp("beg", "end", "r_beg", "r_end").alias("overlap_bp"))


@query(f"""WITH {EV_SQL}, {AN_SQL}, p AS (SELECT event_id, row_id, feat_family, {_SHARED} + 1 AS overlap_bp, row_number() OVER (PARTITION BY event_id ORDER BY {_SHARED} DESC, r_beg, row_id) AS rn FROM ev JOIN an ON {_PAIR})
SELECT event_id, row_id, feat_family, overlap_bp FROM p WHERE rn = 1""")
def q05_overlap_top1(spark, sf):
    got = iv.range_top1(tb.settled_events(spark, sf, columns=tb.PLACE).select("event_id", "ref", "beg", "end"), tb.features(spark, sf).select("row_id", "feat_family", "r_ref", "r_beg", "r_end"), "event_id", ties=["row_id"])
    return got.select("event_id", "row_id", "feat_family", "overlap_bp")


_NEAR = "ev.ref = an.r_ref AND ev.beg - 200 <= an.r_end AND an.r_beg <= ev.end_pos + 200"


@query(f"""WITH {EV_SQL}, {AN_SQL}, p AS (SELECT event_id, CASE WHEN beg <= r_end AND r_beg <= end_pos THEN 0 ELSE abs(least(end_pos + 200, r_end) - greatest(beg - 200, r_beg) - 200) END AS d FROM ev JOIN an ON {_NEAR})
SELECT ev.event_id, count(d) AS n_repeats, CAST(min(d) AS BIGINT) AS distance FROM ev LEFT JOIN p USING (event_id) GROUP BY 1""")
def q06_repeat_distance(spark, sf):
    ev = tb.settled_events(spark, sf, columns=tb.PLACE)
    rep = tb.features(spark, sf).select("r_ref", "r_beg", "r_end", F.col("feat_family").alias("family"), F.col("feat_name").alias("subfamily"))
    near = an.repeat_distances(ev, rep, "event_id").groupBy("event_id").agg(F.count("*").alias("n"), F.min("distance").alias("distance"))
    return ev.select("event_id").join(near, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_repeats"), "distance")


@query(f"""WITH {EV_SQL}, {AN_SQL}, x AS (SELECT DISTINCT event_id FROM ev JOIN an ON ev.ref = an.r_ref AND ev.beg - 10000 <= an.r_end AND an.r_beg <= ev.end_pos + 10000 WHERE feat_family = 'ERVK')
SELECT event_id, ref FROM ev WHERE event_id NOT IN (SELECT event_id FROM x)""")
def q07_range_anti(spark, sf):
    return iv.range_anti(tb.settled_events(spark, sf, columns=tb.PLACE), tb.features(spark, sf).where("feat_family = 'ERVK'"), "event_id", 10_000).select("event_id", "ref")


@query(f"""WITH {EV_SQL}, d AS (SELECT * FROM ev WHERE sv_type = 'DEL')
SELECT a.event_id AS id_a, b.event_id AS id_b, round((least(a.end_pos, b.end_pos) - greatest(a.beg, b.beg) + 1) / (a.end_pos - a.beg)::DOUBLE * 100, 6) AS pct_a,
  round((least(a.end_pos, b.end_pos) - greatest(a.beg, b.beg) + 1) / (b.end_pos - b.beg)::DOUBLE * 100, 6) AS pct_b
FROM d a JOIN d b ON a.ref = b.ref AND a.event_id < b.event_id AND a.beg <= b.end_pos AND b.beg <= a.end_pos
WHERE a.end_pos > a.beg AND b.end_pos > b.beg AND (least(a.end_pos, b.end_pos) - greatest(a.beg, b.beg) + 1) / (a.end_pos - a.beg)::DOUBLE * 100 >= 80
  AND (least(a.end_pos, b.end_pos) - greatest(a.beg, b.beg) + 1) / (b.end_pos - b.beg)::DOUBLE * 100 >= 80""")
def q08_reciprocal_pairs(spark, sf):
    d = tb.settled_events(spark, sf, "DEL", tb.PLACE).select("event_id", "ref", "beg", "end")
    b = d.select(F.col("event_id").alias("id_b"), F.col("ref").alias("r_ref"), F.col("beg").alias("r_beg"), F.col("end").alias("r_end"))
    got = iv.range_join(d, b).where("event_id < id_b").withColumn("p", iv.reciprocal_pct("beg", "end", "r_beg", "r_end")).where("p.pct_a >= 80 and p.pct_b >= 80")
    return got.select(F.col("event_id").alias("id_a"), "id_b", r6("p.pct_a", "pct_a"), r6("p.pct_b", "pct_b"))


@query(f"""WITH {EV_SQL}, {AN_SQL}, p AS (SELECT a.row_id AS id_a, b.row_id AS id_b, greatest(least(a.r_end, b.r_end) - greatest(a.r_beg, b.r_beg) + 1, 0) AS bp, a.r_end - a.r_beg + 1 AS la, b.r_end - b.r_beg + 1 AS lb,
  CASE WHEN a.r_beg > b.r_beg THEN 'LEFT' ELSE 'RIGHT' END AS side
  FROM an a JOIN an b ON a.r_ref = b.r_ref AND a.feat_family = b.feat_family AND a.row_id < b.row_id AND a.r_beg - 100 <= b.r_end + 100 AND b.r_beg - 100 <= a.r_end + 100)
SELECT id_a, id_b, side, bp FROM p WHERE bp / la::DOUBLE * 100 <= 10 AND bp / lb::DOUBLE * 100 <= 10""")
def q09_complementary_pairs(spark, sf):
    f = tb.features(spark, sf)
    a = f.select(F.col("row_id").alias("id_a"), F.col("r_ref").alias("ref"), F.col("r_beg").alias("beg"), F.col("r_end").alias("end"), F.col("feat_family").alias("fam_a"))
    b = f.select(F.col("row_id").alias("id_b"), "r_ref", "r_beg", "r_end", F.col("feat_family").alias("fam_b"))
    got = iv.range_join(a, b, 200, [("fam_a", "fam_b")]).where("id_a < id_b").withColumn("c", iv.complementary("beg", "end", "r_beg", "r_end", 100, 10)).where("c.ok")
    return got.select("id_a", "id_b", "c.side", "c.bp")


# ---- clusters


@query(f"""WITH {EV_SQL}, g AS (SELECT *, beg - lag(beg) OVER (PARTITION BY ref ORDER BY beg, event_id) AS d FROM ev WHERE sv_type = 'CLIPPING'),
k AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY beg, event_id ROWS UNBOUNDED PRECEDING) AS c FROM g)
SELECT ref, CAST(c AS BIGINT) AS cluster_no, count(*) AS n, min(beg) AS beg, max(beg) AS last_beg FROM k GROUP BY 1, 2""")
def q10_gap_clusters(spark, sf):
    k = cl.gap_clusters(tb.settled_events(spark, sf, "CLIPPING", tb.PLACE), ["ref"], "beg", 50, ["event_id"])
    return k.groupBy("ref", "cluster_no").agg(F.count("*").alias("n"), F.min("beg").alias("beg"), F.max("beg").alias("last_beg"))


_CHAIN = f"""{EV_SQL}, it AS (SELECT *, beg // 1000 AS bin FROM ev WHERE sv_type = 'INS' AND beg // 1000 = end_pos // 1000),
bn AS (SELECT ref, bin, min(beg) AS lo, max(end_pos) AS hi FROM it GROUP BY 1, 2),
ch AS (SELECT ref, bin, CAST(sum(f) OVER (PARTITION BY ref ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_no FROM (
  SELECT *, CASE WHEN lag(bin) OVER w IS NULL OR bin - lag(bin) OVER w <> 1 OR lo - lag(hi) OVER w > 200 THEN 1 ELSE 0 END AS f FROM bn WINDOW w AS (PARTITION BY ref ORDER BY bin))),
mem AS (SELECT it.*, cluster_no FROM it JOIN ch USING (ref, bin))"""


def _chained(spark, sf, columns=tb.EVENT):
    return cl.bin_chain_clusters(tb.settled_events(spark, sf, "INS", columns), "ref", "beg", "end", 1000, 200)


@query(f"WITH {_CHAIN} SELECT ref, cluster_no, count(*) AS n, min(beg) AS beg, max(end_pos) AS end_pos FROM mem GROUP BY 1, 2")
def q11_bin_chain_clusters(spark, sf):
    return _chained(spark, sf, tb.PLACE).groupBy("ref", "cluster_no").agg(F.count("*").alias("n"), F.min("beg").alias("beg"), F.max("end").alias("end_pos"))


@query(f"""WITH {EV_SQL}, m AS (SELECT *, max(end_pos) OVER (PARTITION BY ref ORDER BY beg, end_pos, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM ev),
k AS (SELECT *, CAST(sum(CASE WHEN pe IS NULL OR beg > pe THEN 1 ELSE 0 END) OVER (PARTITION BY ref ORDER BY beg, end_pos, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_no FROM m)
SELECT ref, cluster_no, count(*) AS n, min(beg) AS beg, max(end_pos) AS end_pos FROM k GROUP BY 1, 2""")
def q12_components(spark, sf):
    k = cl.overlap_components(tb.settled_events(spark, sf, columns=tb.PLACE), "ref", "beg", "end", 0, ["event_id"])
    return k.groupBy("ref", "cluster_no").agg(F.count("*").alias("n"), F.min("beg").alias("beg"), F.max("end").alias("end_pos"))


_SUPPORT = """sup AS (SELECT ref, cluster_no, count(DISTINCT read_name) AS n_reads,
  CASE WHEN count(*) FILTER (role IS NULL) = 0 THEN count(DISTINCT coalesce(read_name, '~')) FILTER (role = 'TUMOUR') END AS n_tumour,
  CASE WHEN count(*) FILTER (role IS NULL) = 0 THEN count(DISTINCT coalesce(read_name, '~')) FILTER (role = 'NORMAL') END AS n_normal FROM mem GROUP BY 1, 2)"""


@query(f"WITH {_CHAIN}, {_SUPPORT} SELECT * FROM sup")
def q13_cluster_support(spark, sf):
    return ag.support(_chained(spark, sf, (*tb.PLACE, "read_name", "role")), ["ref", "cluster_no"])


@query(f"WITH {_CHAIN} SELECT ref, cluster_no, round(avg(len), 6) AS mean_len, round(stddev_pop(len) * 100 / nullif(avg(len), 0), 6) AS cv FROM mem GROUP BY 1, 2")
def q14_cluster_cv(spark, sf):
    mean, cv = ag.length_cv(F.col("len"))
    return _chained(spark, sf).groupBy("ref", "cluster_no").agg(r6(mean, "mean_len"), r6(cv, "cv"))


@query(f"""WITH {_CHAIN}, o AS (SELECT *, row_number() OVER (PARTITION BY ref, cluster_no ORDER BY len, event_id) - 1 AS i, count(*) OVER (PARTITION BY ref, cluster_no) AS n FROM mem)
SELECT ref, cluster_no, event_id, len FROM o WHERE i = n // 2""")
def q15_median_event(spark, sf):
    return ag.median_event(_chained(spark, sf), ["ref", "cluster_no"], "len", "event_id").select("ref", "cluster_no", "event_id", "len")


@query(f"""WITH {_CHAIN}, c AS (SELECT ref, cluster_no, beg, count(*) AS n FROM mem GROUP BY 1, 2, 3), md AS (SELECT ref, cluster_no, CAST(trunc(median(beg)) AS BIGINT) AS med FROM mem GROUP BY 1, 2),
r AS (SELECT c.*, row_number() OVER (PARTITION BY ref, cluster_no ORDER BY n DESC, abs(beg - med), beg) AS rn FROM c JOIN md USING (ref, cluster_no))
SELECT ref, cluster_no, beg AS breakpoint, n FROM r WHERE rn = 1""")
def q16_breakpoint_mode(spark, sf):
    return ag.breakpoint_mode(_chained(spark, sf, tb.PLACE), ["ref", "cluster_no"], "beg")


@query(f"""WITH {EV_SQL}, i AS (SELECT * FROM ev WHERE sv_type = 'INS' AND read_name IS NOT NULL)
SELECT ref, read_name, min(beg) AS beg, arg_max(end_pos, (beg, event_id)) AS end_pos, count(*) AS n_fragments,
  CASE WHEN min(beg) = max(beg) THEN arg_min(len, (beg, event_id)) ELSE arg_max(end_pos, (beg, event_id)) - min(beg) + CAST(sum(len) AS BIGINT) END AS len FROM i GROUP BY 1, 2""")
def q17_merge_fragments(spark, sf):
    rows = tb.events(spark, sf).where("sv_type = 'INS' and read_name is not null")
    return ag.merge_fragments(rows, ["ref", "read_name"]).withColumnRenamed("end", "end_pos")


def _judged(spark, sf):
    """Clusters with what the filters ask for."""
    m = settle(_chained(spark, sf))
    keys = ["ref", "cluster_no"]
    _, cv = ag.length_cv(F.col("len"))
    stats = m.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("is_dup").alias("n_dup"), cv.alias("cv"), F.avg("mapq").alias("mapq"))
    return stats.join(ag.support(m, keys), keys)


_JUDGED = f"""{_CHAIN}, {_SUPPORT}, st AS (SELECT ref, cluster_no, count(*) AS n, count(*) FILTER (is_dup) AS n_dup, stddev_pop(len) * 100 / nullif(avg(len), 0) AS cv, avg(mapq) AS mapq FROM mem GROUP BY 1, 2),
j AS (SELECT * FROM st JOIN sup USING (ref, cluster_no)),
o AS (SELECT *, n_tumour IS NOT NULL AND n_normal IS NOT NULL AS wr, CASE WHEN n_tumour IS NOT NULL AND n_normal IS NOT NULL THEN n_tumour >= 2 OR n_normal >= 1 ELSE n_reads >= 2 END AS ok FROM j)"""


@query(f"""WITH {_JUDGED} SELECT ref, cluster_no, concat_ws(',', CASE WHEN NOT ok THEN 'MIN-NBREADS' END, CASE WHEN n > 20 THEN 'MAX-NBREADS' END, CASE WHEN NOT coalesce(cv <= 30, false) THEN 'CV' END,
  CASE WHEN NOT coalesce(mapq > 30, false) THEN 'AREAMAPQ' END, CASE WHEN NOT coalesce(n_normal < 1, false) THEN 'GERMLINE' END, CASE WHEN NOT n_dup * 100.0 / n < 75 THEN 'READ-DUP' END) AS failed FROM o""")
def q18_failed_filters(spark, sf):
    c = F.col
    ok, _ = fl.read_support(c("n_reads"), c("n_tumour"), c("n_normal"), 2, 1)
    tests = {
        "MIN-NBREADS": ok, "MAX-NBREADS": c("n") <= 20, "CV": c("cv") <= 30, "AREAMAPQ": c("mapq") > 30, "GERMLINE": c("n_normal") < 1, "READ-DUP": fl.duplicates_below(c("n_dup"), c("n")),
    }
    order = (*fl.META, "READ-DUP")
    return _judged(spark, sf).select("ref", "cluster_no", F.array_join(fl.failed(tests, order), ",").alias("failed"))


@query(f"""WITH {_JUDGED} SELECT ref, cluster_no, ok AS passes, CASE WHEN wr AND n_tumour >= 2 AND n_normal >= 1 THEN 'germline' WHEN wr AND n_tumour >= 2 THEN 'somatic-tumour' WHEN wr AND n_normal >= 1 THEN 'somatic-normal' END AS origin FROM o""")
def q19_mut_origin(spark, sf):
    ok, origin = fl.read_support(F.col("n_reads"), F.col("n_tumour"), F.col("n_normal"), 2, 1)
    return _judged(spark, sf).select("ref", "cluster_no", ok.alias("passes"), origin.alias("origin"))


@query(f"WITH {EV_SQL} SELECT ref, sv_type, count(*) AS n_events, round(count(*) FILTER (is_dup) * 100.0 / count(*), 6) AS dup_pct FROM ev GROUP BY 1, 2")
def q20_dup_percentage(spark, sf):
    return ag.duplicate_pct(tb.events(spark, sf), ["ref", "sv_type"]).select("ref", "sv_type", "n_events", r6("dup_pct", "dup_pct"))


_STAGES = [("source", "SVA"), ("exon", "ERVK"), ("repeat", "Alu")]


@query(f"""WITH {EV_SQL}, {AN_SQL}, p AS (SELECT event_id, feat_name AS label, CASE feat_family WHEN 'SVA' THEN 0 WHEN 'ERVK' THEN 1 ELSE 2 END AS s, {_SHARED} + 1 AS bp FROM ev JOIN an ON {_PAIR} WHERE feat_family IN ('SVA', 'ERVK', 'Alu') AND feat_name IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s, bp DESC, label) AS rn FROM p)
SELECT ev.event_id, label AS identity, ['source', 'exon', 'repeat'][s + 1] AS stage FROM ev LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (event_id)""")
def q21_cascade_identity(spark, sf):
    f = tb.features(spark, sf)
    stages = [(name, f.where(F.col("feat_family") == fam).withColumnRenamed("feat_name", "label")) for name, fam in _STAGES]
    return an.cascade(tb.settled_events(spark, sf, columns=tb.PLACE), stages, "event_id")


@query(f"""WITH {EV_SQL} SELECT CASE WHEN sv_type = 'CLIPPING' THEN CASE WHEN is_reverse THEN 'LEFT-CLIPPING' ELSE 'RIGHT-CLIPPING' END ELSE sv_type END AS event_type, count(*) AS n FROM ev GROUP BY 1""")
def q22_event_subtypes(spark, sf):
    side = F.when(F.col("is_reverse"), "left").otherwise("right")
    kind = ag.event_kind(F.col("sv_type"), side, F.lit("PLUS"))
    return tb.events(spark, sf).groupBy(kind.alias("event_type")).agg(F.count("*").alias("n"))


# ---- sequences and alignments


@query(f"WITH {SQ_SQL} SELECT rec_no, md5(reverse(translate(regexp_replace(seq, '[^ACGTN]', 'N', 'g'), 'ACGT', 'TGCA'))) AS rc_md5 FROM sq")
def q23_revcomp(spark, sf):
    return tb.sequences(spark, sf).select("rec_no", F.md5(sequences.reverse_complement(F.col("seq"))).alias("rc_md5"))


@query(
    f"WITH {SQ_SQL} SELECT rec_no, "
    + ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS INTEGER) AS {b.lower()}" for b in "AGCTN")
    + ", CAST(length(seq) AS INTEGER) AS total, round((length(seq) - length(replace(seq, 'A', ''))) * 100.0 / nullif(length(seq), 0), 6) AS pct_a FROM sq"
)
def q24_base_composition(spark, sf):
    return tb.sequences(spark, sf).select("rec_no", sequences.base_counts(F.col("seq")).alias("c"), r6(sequences.base_pct(F.col("seq"), "A"), "pct_a")).select("rec_no", "c.*", "pct_a")


_LKEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_LIST = _LKEY.split(", ")


@query(f"""WITH {LI_SQL} SELECT {_LKEY}, CAST(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[M=XDN]', 1), lambda x: CAST(x AS INTEGER))) AS INTEGER) AS span FROM li""")
def q25_cigar_span(spark, sf):
    return tb.cigars(spark, sf).select(*_LIST, cigar.ref_span(cigar.cigar_ops("cigar")).alias("span"))


@query(f"""WITH {LI_SQL}, x AS (SELECT *, l_linenumber * 3 AS clip, CAST(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[M=XI]', 1), lambda x: CAST(x AS INTEGER))) AS INTEGER) AS n,
  CAST(list_sum(list_transform(regexp_extract_all(cigar, '(\\d+)[M=XISH]', 1), lambda x: CAST(x AS INTEGER))) AS INTEGER) AS total FROM li)
SELECT {_LKEY}, CAST(CASE WHEN strand = '-' THEN total - clip - n ELSE clip END AS INTEGER) AS q_beg, CAST(CASE WHEN strand = '-' THEN total - clip ELSE clip + n END AS INTEGER) AS q_end FROM x""")
def q26_cigar_query_interval(spark, sf):
    i = cigar.query_interval(cigar.cigar_ops("cigar"), F.col("strand"))
    return tb.cigars(spark, sf).select(*_LIST, i.alias("i")).select(*_LIST, F.col("i.beg").alias("q_beg"), F.col("i.end").alias("q_end"))


@query(f"""WITH {LI_SQL}, a AS (SELECT *, qty + 10 AS m1, l_partkey % 90 + 1 AS ins, l_suppkey % 80 + 5 AS m2, l_orderkey % 70 + 1 AS del FROM li)
SELECT {_LKEY}, 'INS' AS sv_type, l_partkey * 1000 + m1 AS ref_pos, l_partkey * 1000 + m1 AS ref_end, CAST(l_linenumber * 3 + m1 AS BIGINT) AS read_pos, CAST(ins AS INTEGER) AS n FROM a WHERE ins >= 30
UNION ALL SELECT {_LKEY}, 'DEL', l_partkey * 1000 + m1 + m2, l_partkey * 1000 + m1 + m2 + del, CAST(l_linenumber * 3 + m1 + ins + m2 AS BIGINT), CAST(del AS INTEGER) FROM a WHERE del >= 30""")
def q27_indel_events(spark, sf):
    rows = tb.cigars(spark, sf).withColumn("ops", cigar.cigar_ops("cigar")).withColumn("beg", F.expr("l_partkey * 1000"))
    return cigar.indels(rows, "ops", "beg", 30).select(*_LIST, "sv_type", "ref_pos", "ref_end", "read_pos", "n")


@query(f"""WITH {LI_SQL} SELECT {_LKEY}, 'left' AS clipped_side, l_partkey * 1000 AS clip_pos, CAST(l_linenumber * 3 AS INTEGER) AS clip_len FROM li WHERE l_linenumber * 3 >= 10""")
def q28_clip_events(spark, sf):
    rows = tb.cigars(spark, sf).withColumn("ops", cigar.cigar_ops("cigar")).withColumn("beg", F.expr("l_partkey * 1000")).withColumn("end", F.expr("l_partkey * 1000 + 500"))
    return cigar.clip_events(rows, "ops", "beg", "end", 10).select(*_LIST, "clipped_side", "clip_pos", "clip_len")


@query(f"WITH {LI_SQL} SELECT {_LKEY}, chr(CAST(qty % 41 + 33 AS INTEGER)) || chr(CAST(l_linenumber + 33 AS INTEGER)) || chr(CAST(l_suppkey % 60 + 33 AS INTEGER)) AS qual FROM li")
def q29_phred_ascii(spark, sf):
    q = F.array((F.col("qty") % 41).cast("bigint"), F.col("l_linenumber").cast("bigint"), F.col("l_suppkey") % 60)
    return tb.cigars(spark, sf).select(*_LIST, cigar.phred_text(q).alias("qual"))


@query(f"""WITH {LI_SQL}, t AS (SELECT {_LKEY}, 'chr' || (l_suppkey % 22 + 1) || ',' || (l_partkey + 1) || ',' || strand || ',' || cigar || ',60,' || l_linenumber || ';chr' || (l_partkey % 22 + 1) || ',7,+,50M3D,' || qty || ',1;' AS sa FROM li),
u AS (SELECT {_LKEY}, string_split(unnest(list_filter(string_split(sa, ';'), lambda x: x <> '')), ',') AS f FROM t)
SELECT {_LKEY}, f[1] AS ref, CAST(f[2] AS BIGINT) AS beg, CAST(f[2] AS BIGINT) + CAST(list_sum(list_transform(regexp_extract_all(f[4], '(\\d+)[M=XDN]', 1), lambda x: CAST(x AS INTEGER))) AS BIGINT) AS end_pos, f[3] AS strand, CAST(f[5] AS INTEGER) AS mapq, CAST(f[6] AS INTEGER) AS nm FROM u""")
def q30_sa_parse(spark, sf):
    sa = F.expr("concat('chr', l_suppkey % 22 + 1, ',', l_partkey + 1, ',', strand, ',', cigar, ',60,', l_linenumber, ';chr', l_partkey % 22 + 1, ',7,+,50M3D,', qty, ',1;')")
    rows = tb.cigars(spark, sf).select(*_LIST, F.explode(cigar.parse_sa(sa)).alias("s"))
    return rows.select(*_LIST, "s.ref", "s.beg", F.col("s.end").alias("end_pos"), "s.strand", "s.mapq", "s.nm")


@query("SELECT l_partkey AS q_name, count(*) AS n_hits, count(DISTINCT l_suppkey) AS n_targets, max(CAST(l_quantity AS INTEGER)) AS longest FROM lineitem GROUP BY 1")
def q31_hits_by_query(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("q_name")).agg(F.count("*").alias("n_hits"), F.count_distinct("l_suppkey").alias("n_targets"), F.max(F.col("l_quantity").cast("int")).alias("longest"))


@query("""WITH h AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem WHERE l_quantity * 100 / 50 >= 60)
SELECT l_partkey AS q_name, l_orderkey AS t_name, round(l_quantity * 100 / 50, 6) AS pct FROM h WHERE n <= 10""")
def q32_max_hits_filter(spark, sf):
    hits = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("q_name"), F.col("l_orderkey").alias("t_name"), chains.alignment_pct(F.lit(0.0), F.col("l_quantity"), F.lit(50.0)).alias("pct"))
    return chains.max_hits(hits.where("pct >= 60"), "q_name", 10).select("q_name", "t_name", r6("pct", "pct"))


# ---- VCF and BED


@query("""WITH t AS (SELECT call_id, loaded_at, 'ITYPE=' || coalesce(itype, 'None') || ';LEN=' || coalesce(CAST(len_bp AS VARCHAR), '.') || ';TD;FLT=' || coalesce(filter_status, '') AS info FROM ins_calls),
u AS (SELECT call_id, unnest(string_split(info, ';')) AS x FROM t)
SELECT call_id, CASE WHEN strpos(x, '=') > 0 THEN left(x, strpos(x, '=') - 1) ELSE x END AS k, CASE WHEN strpos(x, '=') > 0 THEN substr(x, strpos(x, '=') + 1) ELSE 'true' END AS v, count(*) AS n FROM u GROUP BY 1, 2, 3""")
def q33_info_map(spark, sf):
    text = F.expr("concat('ITYPE=', coalesce(itype, 'None'), ';LEN=', coalesce(cast(len_bp as string), '.'), ';TD;FLT=', coalesce(filter_status, ''))")
    rows = table(spark, sf, "ins_calls").select("call_id", F.explode(info_map(text)).alias("k", "v"))
    return rows.groupBy("call_id", "k", "v").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT DISTINCT call_id, chrom, pos FROM ins_calls WHERE chrom IS NOT NULL)
SELECT chrom, pos, call_id, row_number() OVER (PARTITION BY chrom ORDER BY pos, call_id) AS place FROM d""")
def q34_vcf_sort(spark, sf):
    d = table(spark, sf, "ins_calls").where("chrom is not null").select("chrom", "pos", "call_id").distinct()
    return place(d, ["chrom"], "pos", ["call_id"])


@query(f"WITH {EV_SQL}, {AN_SQL} SELECT feat_name, count(*) AS n, count(DISTINCT r_ref) AS n_refs, min(r_beg) AS beg, max(r_end) AS end_pos FROM an GROUP BY 1")
def q35_bed_by_name(spark, sf):
    f = tb.features(spark, sf)
    return f.groupBy("feat_name").agg(F.count("*").alias("n"), F.count_distinct("r_ref").alias("n_refs"), F.min("r_beg").alias("beg"), F.max("r_end").alias("end_pos"))


@query(f"WITH {EV_SQL} SELECT event_id, ref || '_m' AS ref, end_pos + 500 AS beg, CASE WHEN is_reverse THEN 'PLUS' ELSE 'MINUS' END AS orientation, ref AS mate_ref, beg AS mate_start, CASE WHEN is_reverse THEN 'MINUS' ELSE 'PLUS' END AS mate_orientation FROM ev")
def q36_mate_swap(spark, sf):
    rows = tb.events(spark, sf).selectExpr(
        "event_id", "ref", "beg", "if(is_reverse, 'MINUS', 'PLUS') as orientation", "concat(ref, '_m') as mate_ref", "end + 500 as mate_start", "if(is_reverse, 'PLUS', 'MINUS') as mate_orientation"
    )
    return cigar.swap_mate(rows, ["ref", "beg", "orientation"], ["mate_ref", "mate_start", "mate_orientation"])


# ---- single cell


@query(f"WITH {CELL_SQL}, w AS (SELECT cell_id, ref, unnest(range(beg // 100000, end_pos // 100000 + 1)) AS win FROM cs) SELECT cell_id, ref, win AS \"window\", count(*) AS n_sv FROM w GROUP BY 1, 2, 3 HAVING count(*) >= 3")
def q37_window_svs(spark, sf):
    return sc.window_counts(tb.cell_svs(spark, sf), 100_000, 3)


@query(f"""WITH {CELL_SQL}, g AS (SELECT *, CASE WHEN lag(end_pos) OVER w IS NULL OR beg - lag(end_pos) OVER w > 400000 OR haplotype IS DISTINCT FROM lag(haplotype) OVER w OR abs(af - lag(af) OVER w) > 0.5 THEN 1 ELSE 0 END AS f
  FROM cs WINDOW w AS (PARTITION BY cell_id, ref ORDER BY beg, event_id)),
k AS (SELECT *, CAST(sum(f) OVER (PARTITION BY cell_id, ref ORDER BY beg, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM g)
SELECT cell_id, ref, group_no, min(beg) AS beg, max(end_pos) AS end_pos, min(sv_class) AS sv_class, count(*) AS n_sv FROM k GROUP BY 1, 2, 3""")
def q38_adjacent_groups(spark, sf):
    g = sc.group_adjacent(tb.cell_svs(spark, sf), 400_000, ["beg", "event_id"], ["haplotype"], "af", 0.5)
    return sc.merge_groups(g).withColumnRenamed("end", "end_pos")


@query(f"""WITH {EV_SQL}, {AN_SQL}, b AS (SELECT r_ref AS ref, r_beg AS beg, r_end AS e, max(r_end) OVER (PARTITION BY r_ref ORDER BY r_beg, r_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM an),
h AS (SELECT ref, coalesce(pe, 0) AS beg, beg AS end_pos FROM b UNION ALL SELECT r_ref, max(r_end), max(ref_len) FROM an JOIN contigs ON r_ref = ref_name GROUP BY 1)
SELECT * FROM h WHERE end_pos > beg""")
def q39_complement_intervals(spark, sf):
    f = tb.features(spark, sf).select(F.col("r_ref").alias("ref"), F.col("r_beg").alias("beg"), F.col("r_end").alias("end"))
    f = f.join(broadcast_checked(table(spark, sf, "contigs").select(F.col("ref_name").alias("ref"), "ref_len")), "ref")
    return iv.complement(f, ["ref"], "ref_len").withColumnRenamed("end", "end_pos")


@query(f"""WITH {CELL_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY cell_id, ref ORDER BY beg, event_id) AS i, row_number() OVER (PARTITION BY cell_id, ref ORDER BY end_pos DESC, event_id DESC) AS j FROM cs)
SELECT 'p' AS arm, cell_id, ref, event_id FROM p WHERE i = 1 AND sv_class = 'del' AND beg <= 500000 UNION ALL SELECT 'q', cell_id, ref, event_id FROM p WHERE j = 1 AND sv_class = 'del' AND {CELL_LENGTH} - end_pos <= 58000000""")
def q40_telomeric_del(spark, sf):
    rows = tb.cell_svs(spark, sf).withColumn("ref_len", F.lit(CELL_LENGTH))
    p = sc.telomeric_deletion(rows, "p").select(F.lit("p").alias("arm"), "cell_id", "ref", "event_id")
    return p.unionByName(sc.telomeric_deletion(rows, "q", max_dist=58_000_000).select(F.lit("q").alias("arm"), "cell_id", "ref", "event_id"))


@query(f"""WITH {CELL_SQL}, r AS (SELECT *, row_number() OVER w AS i, beg - lag(end_pos) OVER w AS gap FROM cs WINDOW w AS (PARTITION BY cell_id, ref ORDER BY beg, event_id)),
o AS (SELECT *, min(CASE WHEN i = 1 OR (sv_class IN ('complex', 'dup', 'idup') AND gap <= 7000000) THEN 1 ELSE 0 END) OVER (PARTITION BY cell_id, ref ORDER BY beg, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT cell_id, ref, count(*) AS n_run, count(*) FILTER (sv_class IN ('dup', 'idup')) AS n_dup FROM o WHERE run = 1 AND i > 1 GROUP BY 1, 2 HAVING count(*) FILTER (sv_class IN ('dup', 'idup')) > 0""")
def q41_adjacent_dup_bfb(spark, sf):
    return sc.adjacent_duplications(tb.cell_svs(spark, sf), "p")


# ---- haplotypes

_COMPARE = f"""{HAP_SQL}, s AS (SELECT pos, state, 1 - count(*) / sum(count(*)) OVER (PARTITION BY pos) AS score FROM hp GROUP BY 1, 2),
r AS (SELECT seq_id AS ref_id, pos, state, score FROM hp JOIN s USING (pos, state)), tot AS (SELECT ref_id, sum(score) AS alls FROM r GROUP BY 1),
hit AS (SELECT t.seq_id AS target, ref_id, sum(CASE WHEN t.state = r.state THEN score ELSE 0 END) AS h FROM hp t JOIN r ON t.pos = r.pos WHERE t.seq_id % 20 = 0 AND ref_id <> t.seq_id GROUP BY 1, 2),
cmp AS (SELECT target, ref_id, floor(h / alls * 100 + 0.500001) / 100.0 AS score FROM hit JOIN tot USING (ref_id) WHERE alls > 0)"""


def _compared(spark, sf):
    h = tb.haplotypes(spark, sf)
    return hp.compare(h.where("seq_id % 20 = 0"), h, hp.diagnostic_scores(h)).where("target <> ref_id")


@query(f"WITH {_COMPARE} SELECT * FROM cmp")
def q42_haplotype_scores(spark, sf):
    return _compared(spark, sf)


@query(f"""WITH {_COMPARE}, k AS (SELECT *, dense_rank() OVER (PARTITION BY target ORDER BY score DESC) AS r FROM cmp),
g AS (SELECT target, max(score) AS best, min(score) FILTER (r = 2) AS second, count(*) FILTER (r = 1) AS n, min(ref_id) FILTER (r = 1) AS ref_id FROM k WHERE r <= 2 GROUP BY 1)
SELECT target, ref_id, best, second, round(log2(best / second), 6) AS log_ratio FROM g WHERE n = 1 AND second > 0 AND log2(best / second) >= 0.01""")
def q43_haplotype_assign(spark, sf):
    return hp.assign(_compared(spark, sf), 0.01).withColumn("log_ratio", F.round("log_ratio", 6))


# ---- dictionaries, regions, tails


@query(f"WITH {EV_SQL} SELECT ref, count(*) AS n, count(DISTINCT read_name) AS n_distinct FROM ev WHERE sv_type IN ('INS', 'DEL') GROUP BY 1")
def q44_merge_dictionaries(spark, sf):
    ev = tb.events(spark, sf)
    return ag.merge_grouped([ev.where(F.col("sv_type") == t).select("ref", "read_name") for t in ("INS", "DEL")], ["ref"], "read_name")


@query(f"""WITH {EV_SQL}, {AN_SQL}, x AS (SELECT *, unnest(['3', '5']) AS src_end FROM an WHERE feat_family = 'L1' AND strand IN ('+', '-')),
d AS (SELECT *, (strand = '+' AND src_end = '3') OR (strand = '-' AND src_end = '5') AS down FROM x)
SELECT row_id, src_end, r_ref AS ref, greatest(CASE WHEN down THEN r_end - 150 ELSE r_beg - 10000 END, 0) AS beg, CASE WHEN down THEN r_end + 10000 ELSE r_beg + 150 END AS end_pos FROM d""")
def q45_transduced_regions(spark, sf):
    src = tb.features(spark, sf).where("feat_family = 'L1' and strand in ('+', '-')").select("row_id", F.col("r_ref").alias("ref"), F.col("r_beg").alias("beg"), F.col("r_end").alias("end"), "strand")
    return an.transduced_regions(src, ["3", "5"]).select("row_id", "src_end", "ref", "beg", F.col("end").alias("end_pos"))


@query(f"""WITH {SQ_SQL} SELECT rec_no, coalesce((length(seq) - length(replace(seq, 'A', ''))) * 100.0 / nullif(length(seq), 0) >= 26, false) OR coalesce((length(seq) - length(replace(seq, 'T', ''))) * 100.0 / nullif(length(seq), 0) >= 26, false) AS rich,
  CAST(length(regexp_extract(seq, '(A{{2,}})$', 1)) AS INTEGER) AS tail, md5(regexp_replace(seq, 'A{{2,}}$', '')) AS trimmed FROM sq""")
def q46_polyA(spark, sf):
    t = sequences.trim_poly_a(F.col("seq"), 2)
    rich = F.coalesce(sequences.base_pct(F.col("seq"), "A") >= 26, F.lit(False)) | F.coalesce(sequences.base_pct(F.col("seq"), "T") >= 26, F.lit(False))
    return tb.sequences(spark, sf).select("rec_no", rich.alias("rich"), t.alias("t")).select("rec_no", "rich", F.col("t.cut").alias("tail"), F.md5("t.seq").alias("trimmed"))


@query()
def q47_exact_reciprocal(spark, sf):
    d = tb.settled_events(spark, sf, "DEL", tb.PLACE)
    return cl.reciprocal_clusters(d, "ref", "beg", "end", "event_id", 20.0, 0, 2).withColumnRenamed("end", "end_pos")


@query(f"""WITH {SQ_SQL}, b AS (SELECT rec_no, reverse(seq) AS s, length(seq) AS n FROM sq WHERE length(seq) > 0), t AS (SELECT rec_no, s, n, unnest(range(0, n // 8)) AS k FROM b),
g AS (SELECT * FROM t WHERE length(substr(s, CAST(k * 8 + 1 AS INTEGER), 8)) - length(replace(substr(s, CAST(k * 8 + 1 AS INTEGER), 8), 'A', '')) >= 6),
r AS (SELECT *, sum(f) OVER (PARTITION BY rec_no ORDER BY k ROWS UNBOUNDED PRECEDING) AS no FROM (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY rec_no ORDER BY k) <= 3 THEN 0 ELSE 1 END AS f FROM g)),
m AS (SELECT rec_no, any_value(s) AS s, any_value(n) AS n, min(k) * 8 AS b, (max(k) + 1) * 8 AS e FROM r GROUP BY rec_no, no),
x AS (SELECT rec_no, n, b - length(regexp_extract(substr(s, 1, CAST(b AS INTEGER)), 'A*$')) AS b, e + length(regexp_extract(substr(s, CAST(e + 1 AS INTEGER)), '^A*')) AS e FROM m)
SELECT rec_no, CAST(n - e AS INTEGER) AS beg, CAST(n - b AS INTEGER) AS end_pos FROM x WHERE e - b >= 10""")
def q48_monomers(spark, sf):
    s = tb.sequences(spark, sf).withColumn("m", sequences.monomers(F.col("seq"), "A", window=8, max_dist=2, least=10, purity=75.0, backward=True))
    return s.select("rec_no", F.explode("m").alias("m")).select("rec_no", F.col("m.beg").alias("beg"), F.col("m.end").alias("end_pos"))


_BESIDE = "lo - 10000 <= h[i].e + 10000 AND h[i].b - 10000 <= hi + 10000"
_COMMON = "greatest(0, least(hi, h[i].e) - greatest(lo, h[i].b) + 1)"


@query(f"""WITH RECURSIVE {KNOWN_SQL}, {AN_SQL}, g AS (SELECT concat_ws(':', track_id, r_ref) AS q_name, list(struct_pack(b := r_beg, e := r_end, f := feat_family) ORDER BY r_beg - r_end, r_beg, row_id) AS h FROM an GROUP BY 1),
st AS (SELECT q_name, h, h[1].b AS lo, h[1].e AS hi, [CAST(1 AS BIGINT)] AS used FROM g
  UNION ALL SELECT q_name, h, CASE WHEN lo > h[i].b THEN h[i].b ELSE lo END, CASE WHEN lo > h[i].b THEN hi ELSE h[i].e END, list_append(used, i) FROM (
    SELECT *, list_filter(range(1, len(h) + 1), lambda i: NOT list_contains(used, i) AND {_BESIDE} AND {_COMMON} / (hi - lo + 1)::DOUBLE * 100 <= 20 AND {_COMMON} / (h[i].e - h[i].b + 1)::DOUBLE * 100 <= 20)[1] AS i FROM st) WHERE i IS NOT NULL),
f AS (SELECT q_name, arg_max(struct_pack(lo := lo, hi := hi, used := used, h := h), len(used)) AS c FROM st GROUP BY 1)
SELECT q_name, c.lo AS chain_beg, c.hi AS chain_end, len(c.used) AS n_hits, CAST(c.hi - c.lo AS DOUBLE) * 100 / 50000000 AS pct_covered,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(c.used, lambda i: c.h[i].f), lambda x: x IS NOT NULL))), ',') AS targets FROM f""")
def q49_paf_chain(spark, sf):
    """Features of one track and contig as hits of one query."""
    f = tb.features(spark, sf).select(F.concat_ws(":", "track_id", "r_ref").alias("q_name"), F.col("r_beg").alias("q_beg"), F.col("r_end").alias("q_end"), F.col("feat_family").alias("t_name"), "row_id", F.lit(50_000_000).cast("bigint").alias("q_len"))
    return chains.chain_summary(chains.chain_hits(f, "q_name", "q_beg", "q_end", ["row_id"], 10_000, 20.0), "q_name", "q_beg", "q_end", "q_len", "t_name").withColumn("targets", F.array_join("targets", ","))


@query()
def q50_kmeans(spark, sf):
    m = _chained(spark, sf).withColumn("len", F.col("len").cast("double"))
    _, cv = ag.length_cv(F.col("len"))
    wide = m.groupBy("ref", "cluster_no").agg(cv.alias("cv")).where("cv > 15").select("ref", "cluster_no")
    return cl.kmeans_clusters(m.join(wide, ["ref", "cluster_no"]), ["ref", "cluster_no"], "event_id", ["len"])
