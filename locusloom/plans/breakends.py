"""Queries over breakpoints, bridges and junctions, haplotype vectors and viral reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import breakpoints as bp
from ..operators import events as ev
from ..operators import haplotype as hp
from ..operators import junctions as jn
from ..operators import retro
from ..session import settle, table
from . import tables as tb
from .reference import query
from .tables import AN_SQL, EV_SQL


@query(f"""WITH {EV_SQL}, d AS (SELECT ref || ':' || beg // 5000 AS k, ref, beg, end_pos, read_name, CASE WHEN is_reverse THEN 'MINUS' ELSE 'PLUS' END AS o, event_id % 4 = 0 AS clip FROM ev WHERE sv_type = 'DEL'),
c AS (SELECT event_id AS cid, ref AS c_ref, beg AS c_beg, CASE WHEN event_id % 2 = 0 THEN 'right' ELSE 'left' END AS side, read_name AS c_read, repeat('A', CAST(event_id % 3 + 1 AS INTEGER)) AS rp, repeat('C', CAST(event_id % 5 + 1 AS INTEGER)) AS cp FROM ev WHERE sv_type = 'CLIPPING'),
a AS (SELECT k, o, any_value(ref) AS ref, min(p) FILTER (clip) AS lo, max(p) FILTER (clip) AS hi, min(beg) AS b, max(end_pos) AS e FROM (SELECT *, CASE o WHEN 'PLUS' THEN end_pos ELSE beg END AS p FROM d) GROUP BY 1, 2),
ar AS (SELECT k, o, ref, lo IS NOT NULL AS from_clip, greatest(coalesce(lo - 5, CASE o WHEN 'PLUS' THEN b ELSE b - 5000 END), 0) AS area_beg, coalesce(hi + 5, CASE o WHEN 'PLUS' THEN e + 5000 ELSE e END) AS area_end FROM a),
own AS (SELECT DISTINCT k, o, read_name FROM d WHERE clip AND read_name IS NOT NULL),
n AS (SELECT ar.k, ar.o, c_beg, rp, cp, c.side, CASE WHEN own.k IS NOT NULL THEN 0 WHEN cid % 3 = 0 THEN 1 ELSE 2 END AS r FROM ar JOIN c ON c_ref = ref AND side = CASE o WHEN 'PLUS' THEN 'right' ELSE 'left' END AND c_beg BETWEEN area_beg AND area_end
  LEFT JOIN own ON own.k = ar.k AND own.o = ar.o AND own.read_name = c_read),
b AS (SELECT * FROM (SELECT *, min(r) OVER (PARTITION BY k, o) AS best FROM n) WHERE r = best),
m AS (SELECT k, o, sum(n) AS n_clips, min(r) AS r, arg_min(c_beg, (-n, c_beg)) AS breakpoint FROM (SELECT k, o, c_beg, min(r) AS r, count(*) AS n FROM b GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT k, o, arg_min(x, (-length(cp), x)) AS text FROM (SELECT *, CASE side WHEN 'right' THEN rp || '[INT]>' || cp ELSE cp || '<[INT]' || rp END AS x FROM b) GROUP BY 1, 2)
SELECT ar.k AS meta, ar.o AS side, area_beg, area_end, from_clip, CAST(coalesce(n_clips, 0) AS BIGINT) AS n_clips, ['discordant', 'matched', 'regular'][r + 1] AS source, breakpoint, text FROM ar LEFT JOIN m ON ar.k = m.k AND ar.o = m.o LEFT JOIN t ON ar.k = t.k AND ar.o = t.o""")
def q100_breakpoints(spark, sf):
    """Deletions in 5 kb stretches as discordant clusters, every fourth clipped; clippings divisible by three matched."""
    e = tb.settled_events(spark, sf)
    d = e.where("sv_type = 'DEL'").select(F.concat_ws(":", "ref", F.expr("beg div 5000")).alias("meta"), "ref", "beg", "end", "read_name", F.expr("if(is_reverse, 'MINUS', 'PLUS')").alias("orientation"), (F.col("event_id") % 4 == 0).alias("clip"))
    c = e.where("sv_type = 'CLIPPING'").select(
        F.col("event_id").alias("clip_id"), "ref", "beg", F.expr("if(event_id % 2 = 0, 'right', 'left')").alias("side"), "read_name",
        F.expr("repeat('A', cast(event_id % 3 + 1 as int))").alias("ref_part"), F.expr("repeat('C', cast(event_id % 5 + 1 as int))").alias("clip_part"),
    )
    return bp.analyse(d, c, "meta", 5_000, c.where("clip_id % 3 = 0").select("clip_id"))


@query(f"""WITH {EV_SQL}, {AN_SQL}, p AS (SELECT event_id, CASE WHEN feat_family = 'SVA' THEN 1 ELSE 0 END AS kind, coalesce(feat_name, '') AS label, (least(end_pos, r_end) - greatest(beg, r_beg)) * 100.0::DOUBLE / (end_pos - beg) AS pct
  FROM ev JOIN an ON ref = r_ref AND beg <= r_end AND r_beg <= end_pos WHERE end_pos > beg AND end_pos - beg <= 10000 AND feat_family IN ('SVA', 'Alu', 'L1') AND feat_name IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY kind, pct DESC, label) AS rn FROM p WHERE pct > 20)
SELECT event_id, CASE kind WHEN 0 THEN 'solo' ELSE 'transduced' END AS bridge_type, label, round(pct, 6) AS pct FROM r WHERE rn = 1""")
def q101_aligned_bridges(spark, sf):
    f = tb.features(spark, sf).withColumnRenamed("feat_name", "label")
    e = tb.settled_events(spark, sf).select("event_id", "ref", "beg", "end")
    got = jn.aligned_bridges(e, f.where("feat_family = 'SVA'"), f.where("feat_family in ('Alu', 'L1')"), "event_id", 10_000, 20.0)
    return got.withColumn("pct", F.round("pct", 6))


@query("""WITH s AS (SELECT l_orderkey % 3000 AS meta, l_suppkey % 4 AS cluster_id, l_partkey AS read_name, CASE WHEN l_suppkey % 4 = 1 OR l_suppkey % 4 = 3 AND l_orderkey % 2 = 0 THEN 'unaligned' ELSE 'aligned' END AS support_type,
  CASE WHEN (l_suppkey % 4 + l_orderkey % 3000) % 3 = 0 THEN 'solo' ELSE 'transduced' END AS bridge_type, 40 AS total FROM lineitem),
u AS (SELECT meta, cluster_id, any_value(bridge_type) AS bt, count(DISTINCT read_name) AS n FROM s WHERE support_type = 'unaligned' GROUP BY 1, 2),
f AS (SELECT meta, arg_min(cluster_id, (-n, cluster_id)) AS cid, arg_min(bt, (-n, cluster_id)) AS bt FROM u GROUP BY 1),
c AS (SELECT s.* FROM s LEFT JOIN f USING (meta) WHERE cid IS NULL OR CASE support_type WHEN 'unaligned' THEN cluster_id = cid ELSE bridge_type = bt END),
g AS (SELECT meta, count(DISTINCT read_name) AS n_reads, array_to_string(list_sort(list_distinct(list(support_type))), ',') AS support_types, min(bridge_type) AS lo, max(bridge_type) AS hi FROM c GROUP BY 1)
SELECT meta, CASE WHEN lo = hi THEN lo ELSE 'unknown' END AS bridge_type, n_reads, round(n_reads * 100.0 / 40, 6) AS pct, support_types FROM g WHERE n_reads >= 3 AND n_reads * 100.0 / 40 >= 20""")
def q102_bridges(spark, sf):
    """Line items as reads that support one of four bridge clusters per metacluster."""
    s = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey % 3000 as meta", "l_suppkey % 4 as cluster_id", "l_partkey as read_name", "if(l_suppkey % 4 = 1 or l_suppkey % 4 = 3 and l_orderkey % 2 = 0, 'unaligned', 'aligned') as support_type",
        "if((l_suppkey % 4 + l_orderkey % 3000) % 3 = 0, 'solo', 'transduced') as bridge_type", "40 as total",
    )
    got = jn.search_bridge(s, "meta", "total", 3, 20.0)
    return got.withColumn("pct", F.round("pct", 6)).withColumn("support_types", F.array_join("support_types", ","))


@query("""WITH m AS (SELECT 'm' || (l_suppkey % 60) AS meta, l_orderkey AS read_name, l_quantity % 7 AS n_sa FROM lineitem), e AS (SELECT 'm' || i AS meta_a, 'm' || (i + 1) AS meta_b FROM (SELECT unnest(range(0, 60, 2)) AS i)),
s AS (SELECT meta_a, meta_b, unnest([meta_a, meta_b]) AS x FROM e), r AS (SELECT meta_a, meta_b, read_name, count(DISTINCT x) AS sides, min(n_sa) AS n_sa FROM s JOIN m ON x = meta GROUP BY 1, 2, 3)
SELECT *, row_number() OVER (PARTITION BY meta_a, meta_b ORDER BY sides DESC, n_sa, read_name) AS place FROM r""")
def q103_template_reads(spark, sf):
    m = table(spark, sf, "lineitem").select(F.concat(F.lit("m"), F.col("l_suppkey") % 60).alias("meta"), F.col("l_orderkey").alias("read_name"), (F.col("l_quantity") % 7).alias("n_sa"))
    edges = spark.range(0, 60, 2).select(F.concat(F.lit("m"), "id").alias("meta_a"), F.concat(F.lit("m"), F.col("id") + 1).alias("meta_b"))
    return jn.template_reads(m, edges)


_VARIANTS = "l_suppkey AS seq_id, CAST(l_partkey % 45 AS INTEGER) AS pos, ['A', 'C', 'G', 'T', 'AC'][l_partkey % 5 + 1] AS ref, ['T', 'G', 'C', 'A', 'TTG'][l_orderkey % 5 + 1] AS alt"


@query(f"""WITH v AS (SELECT {_VARIANTS} FROM lineitem), k AS (SELECT unnest(['A', 'C', 'G', 'T']) AS r), q AS (SELECT a.r AS ref, b.r AS alt, row_number() OVER (ORDER BY a.r, b.r) AS code FROM k a, k b WHERE a.r <> b.r),
s AS (SELECT seq_id, pos, min(CAST(code AS VARCHAR)) AS snp, min(CASE WHEN length(v.ref) > length(v.alt) THEN '-' || v.ref WHEN length(v.ref) < length(v.alt) THEN '+' || v.alt END) AS indel FROM v LEFT JOIN q ON v.ref = q.ref AND v.alt = q.alt GROUP BY 1, 2),
p AS (SELECT seq_id, CAST(unnest(range(1, 41)) AS INTEGER) AS pos FROM (SELECT DISTINCT seq_id FROM v))
SELECT p.seq_id, p.pos, coalesce(snp, '0') AS snp, coalesce(indel, '0') AS indel FROM p LEFT JOIN s ON s.seq_id = p.seq_id AND s.pos = p.pos""")
def q104_haplotype_states(spark, sf):
    """Substitution and indel vectors of 40 positions per sequence, from variants one of which may lie outside."""
    base = lambda names, c: f"element_at(array({', '.join(repr(n) for n in names)}), cast({c} % 5 as int) + 1)"
    v = table(spark, sf, "lineitem").selectExpr("l_suppkey as seq_id", "cast(l_partkey % 45 as int) as pos", f"{base(('A', 'C', 'G', 'T', 'AC'), 'l_partkey')} as ref", f"{base(('T', 'G', 'C', 'A', 'TTG'), 'l_orderkey')} as alt")
    snp = hp.haplotype_states(v, 40, "snp").withColumnRenamed("state", "snp")
    return snp.join(hp.haplotype_states(v, 40, "indel").withColumnRenamed("state", "indel"), ["seq_id", "pos"])


@query(f"""WITH {EV_SQL}, l AS (SELECT read_name, min('v' || (event_id % 7)) AS label FROM ev WHERE sv_type = 'INS' AND read_name IS NOT NULL GROUP BY 1)
SELECT 'DISCORDANT-' || coalesce(label, 'None') AS kind, count(*) AS n_events, count(DISTINCT ev.read_name) AS n_reads FROM ev LEFT JOIN l ON ev.read_name = l.read_name WHERE sv_type = 'CLIPPING' GROUP BY 1""")
def q105_viral_events(spark, sf):
    """Clippings as discordant events, labelled by the viral hits of their reads and counted per label."""
    e = settle(tb.events(spark, sf).select("event_id", "read_name", "sv_type"))
    labels = e.where("sv_type = 'INS' and read_name is not null").select("read_name", F.concat(F.lit("v"), F.col("event_id") % 7).alias("label"))
    return ev.label_groups_by_kind(ev.label_by_read(e.where("sv_type = 'CLIPPING'"), labels))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber % 2 AS fam, l_orderkey % 3 + l_linenumber % 2 * (l_orderkey % 2) AS acc FROM lineitem)
SELECT l_orderkey, CASE WHEN count(DISTINCT acc) = 1 THEN 'viralSolo' WHEN count(DISTINCT fam) = 1 THEN 'viralFamilyNested' ELSE 'viralNested' END AS ins_type FROM h GROUP BY 1""")
def q106_virus_types(spark, sf):
    """Chains of viral hits named family|accession|description, by the accessions and families in them."""
    li = table(spark, sf, "lineitem")
    name = F.expr("concat('f', l_linenumber % 2, '|', l_orderkey % 3 + l_linenumber % 2 * (l_orderkey % 2), '|d')")
    hit = F.struct((F.col("l_linenumber") * 100).cast("bigint").alias("q_beg"), (F.col("l_linenumber") * 100 + 50).cast("bigint").alias("q_end"), name.alias("tname"), F.lit("+").alias("strand"), F.lit(0).cast("bigint").alias("t_beg"), F.lit(50).cast("bigint").alias("t_end"), F.lit(100).cast("bigint").alias("t_len"))
    kind = retro.virus_type(F.col("chain"))["ins_type"]
    return li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(hit)).alias("chain")).select("l_orderkey", kind.alias("ins_type"))
