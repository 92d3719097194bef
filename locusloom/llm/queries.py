"""Queries p1 and p6 to p9 over the project's tables, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.contigs import squeeze
from ..operators.hotkeys import newest_per_id
from ..plans.problems import FAMILY_SQL, family
from ..session import fixed_rows, settle, table
from . import areas as ar
from . import qdigest as qd
from .mixing import mix
from .packing import CAPACITY, pack
from .split import PROSE, cut_cores, interval_cuts, run_boundary, split_text
from .tokens import count_tokens

Query = Callable[[SparkSession, str], DataFrame]

SEQ_LIMIT, SEQ_OVERLAP, SEQ_RUN = 6_000, 200, 10
CONTIG_LIMIT, CONTIG_OVERLAP = 20_000_000, 10_000
TEXT_LIMIT, TEXT_OVERLAP = 8_000, 200
LOW, HIGH = 1, 1_000_000
PCTS = [50, 90]


# ---- p1: oversized items


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "fasta_seqs").select("rec_no", "seq_header", "seq")
    return rows.select(
        "rec_no",
        F.regexp_extract("seq_header", r"^\s*>?\s*(\S+)", 1).alias("item_id"),
        F.upper(F.regexp_replace("seq", r"\s+", "")).alias("bases"),
    )


def _contig_cuts(spark: SparkSession, sf: str) -> DataFrame:
    gaps = (
        table(spark, sf, "ref_gaps")
        .groupBy("ref_name")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("gap_beg").alias("gb"), F.col("gap_end").alias("ge")))).alias("gaps"))
    )
    big = table(spark, sf, "contigs").where(F.col("ref_len") > CONTIG_LIMIT).select("ref_name", "ref_len")
    cut = big.join(gaps, "ref_name", "left")
    return cut.select("ref_name", "ref_len", interval_cuts(F.col("ref_len"), F.col("gaps"), CONTIG_LIMIT, CONTIG_OVERLAP).alias("cuts"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The cuts of each record are made where it is read; only their kind is shuffled to pick an id's last record."""
    seqs = _sequences(spark, sf)
    _, forced = cut_cores(F.col("bases"), SEQ_LIMIT, SEQ_OVERLAP, (run_boundary("N", SEQ_RUN),))
    kind = F.when(F.length("bases") > SEQ_LIMIT, F.when(F.exists(F.slice(forced, 1, F.greatest(F.size(forced) - 1, F.lit(0))), lambda x: x), "forced").otherwise("boundary"))
    last = seqs.select("item_id", "rec_no", kind.alias("kind")).where("item_id <> ''").groupBy("item_id").agg(F.max_by("kind", "rec_no").alias("cut_kind"))
    of_seqs = last.where("cut_kind is not null").select(F.lit("seq").alias("item_kind"), "item_id", "cut_kind")
    of_contigs = _contig_cuts(spark, sf).select(
        F.lit("contig").alias("item_kind"), F.col("ref_name").alias("item_id"), F.when(F.exists("cuts", lambda c: c["forced"]), "forced").otherwise("boundary").alias("cut_kind")
    )
    return of_seqs.unionByName(of_contigs)


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Every piece of every oversized sequence and contig, as positions."""
    seqs = _sequences(spark, sf)
    last = seqs.where("item_id <> ''").groupBy("item_id").agg(F.max("rec_no").alias("rec_no"))
    now = seqs.where(F.length("bases") > SEQ_LIMIT).join(last.select("rec_no"), "rec_no", "left_semi")
    of_seqs = split_text(now, "item_id", "bases", SEQ_LIMIT, SEQ_OVERLAP, (run_boundary("N", SEQ_RUN),)).select(
        F.lit("seq").alias("item_kind"), "item_id", "piece_no", "beg", "end_pos", F.length("piece").cast("bigint").alias("size"), "forced"
    )
    # the end of the item is a cut that closes the last piece
    ends = F.concat("cuts", F.array(F.struct(F.col("ref_len").alias("pos"), F.lit(False).alias("forced"))))
    of_contigs = (
        _contig_cuts(spark, sf)
        .withColumn("ends", ends)
        .select("ref_name", "ends", F.posexplode("ends").alias("piece_no", "e"))
        .withColumn("from", F.when(F.col("piece_no") > 0, F.greatest(F.get("ends", F.col("piece_no") - 1)["pos"] - CONTIG_OVERLAP, F.lit(0))).otherwise(F.lit(0)))
        .select(
            F.lit("contig").alias("item_kind"), F.col("ref_name").alias("item_id"), "piece_no", F.col("from").cast("bigint").alias("beg"), F.col("e.pos").alias("end_pos"),
            (F.col("e.pos") - F.col("from")).cast("bigint").alias("size"), F.col("e.forced").alias("forced"),
        )
    )
    return of_seqs.unionByName(of_contigs)


def p1_text_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Commit texts beyond a length cut at paragraphs, lines, sentences or words."""
    got = split_text(table(spark, sf, "documents"), "doc_id", "text", TEXT_LIMIT, TEXT_OVERLAP, PROSE, least=(TEXT_LIMIT - TEXT_OVERLAP) // 2)
    return got.select("doc_id", "piece_no", "beg", "end_pos", F.length("piece").cast("bigint").alias("size"), "forced")


_P1_SQL = f"""WITH s AS (SELECT regexp_extract(seq_header, '^\\s*>?\\s*(\\S+)', 1) AS item_id, rec_no, upper(regexp_replace(seq, '\\s+', '', 'g')) AS bases FROM fasta_seqs),
l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rec_no DESC) AS rn FROM s WHERE item_id <> ''),
q AS (SELECT item_id, list_max(list_transform(regexp_split_to_array(bases, 'N{{{SEQ_RUN},}}'), lambda x: length(x))) AS free FROM l WHERE rn = 1 AND length(bases) > {SEQ_LIMIT}),
g AS (SELECT ref_name, gap_beg, gap_end FROM ref_gaps UNION ALL SELECT ref_name, 0, 0 FROM contigs UNION ALL SELECT ref_name, ref_len, ref_len FROM contigs),
h AS (SELECT ref_name, gap_beg - lag(gap_end) OVER (PARTITION BY ref_name ORDER BY gap_beg, gap_end) AS free FROM g),
c AS (SELECT h.ref_name, max(free) AS free FROM h JOIN contigs USING (ref_name) WHERE ref_len > {CONTIG_LIMIT} GROUP BY 1)
SELECT 'seq' AS item_kind, item_id, CASE WHEN free <= {SEQ_LIMIT - SEQ_OVERLAP} THEN 'boundary' ELSE 'forced' END AS cut_kind FROM q
UNION ALL SELECT 'contig', ref_name, CASE WHEN free <= {CONTIG_LIMIT - CONTIG_OVERLAP} THEN 'boundary' ELSE 'forced' END FROM c"""


# ---- p6: percentiles


def _measures(spark: SparkSession, sf: str) -> DataFrame:
    """(batch_id, fam, measure, value, leaf): each call once, values within the universe."""
    calls = table(spark, sf, "ins_calls").select("call_id", "batch_id", "fam", "len_bp", "nbtotal", "loaded_at").withColumn("family", family())
    once = newest_per_id(calls, "call_id", "loaded_at", {"batch_id": F.col("batch_id"), "fam": F.col("family"), "len": F.col("len_bp"), "nbtotal": F.col("nbtotal")})
    once = settle(once.where("fam is not null").select("batch_id", "fam", "len", "nbtotal"))
    long = once.select("batch_id", "fam", F.expr("stack(2, 'len', len, 'nbtotal', nbtotal) as (measure, value)"))
    return long.where(F.col("value").between(LOW, HIGH)).withColumn("leaf", qd.leaf_of(F.col("value"), LOW, HIGH))


_BATCH, _ALL = ["batch_id", "fam", "measure"], ["fam", "measure"]


def _percentiles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, brackets per batch, brackets of all batches): the latter from the batches' digests alone."""
    values = _measures(spark, sf)
    per_batch = settle(qd.build(values, _BATCH, "leaf"))
    of_all = qd.merge(per_batch, _ALL)
    return values, qd.quantiles(per_batch, _BATCH, PCTS, LOW), qd.quantiles(of_all, _ALL, PCTS, LOW)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Decided by the digests, those of all batches being merged ones: the least value of a batch's bracket beyond
    twice the greatest of the bracket of all is a case, the greatest up to twice the least is none. Only percentiles
    whose brackets leave it open are checked against the values."""
    values, batch, whole = _percentiles(spark, sf)
    of_all = whole.select("fam", "measure", "pct", F.col("n").alias("all_n"), F.col("at_least").alias("all_least"), F.col("at_most").alias("all_most"))
    near = settle(batch.where("n >= 40").join(of_all, [*_ALL, "pct"]).where("at_most > 2 * all_least"))
    sure = near.where("at_least > 2 * all_most").select(*_BATCH, "pct")
    unsure = near.where("at_least <= 2 * all_most")
    if unsure.limit(1).count() == 0:
        return sure
    b = qd.resolve(unsure.select(*_BATCH, "pct", "n", "at_least", "at_most"), values, _BATCH, "value")
    w = unsure.select(*_ALL, "pct", F.col("all_n").alias("n"), F.col("all_least").alias("at_least"), F.col("all_most").alias("at_most")).distinct()
    w = qd.resolve(w, values, _ALL, "value").select(*_ALL, "pct", F.col("exact").alias("of_all"))
    return sure.unionByName(b.join(w, [*_ALL, "pct"]).where("exact > 2 * of_all").select(*_BATCH, "pct"))


def p6_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Median and 90th percentile of every batch and, as batch -1, of all batches: the digest's answer is checked
    against the exact value, which lies in its bracket."""
    values, batch, whole = _percentiles(spark, sf)
    whole, batch = settle(whole), settle(batch)
    a = qd.resolve(batch, values, _BATCH, "value")
    b = qd.resolve(whole, values, _ALL, "value").withColumn("batch_id", F.lit(-1).cast("bigint"))
    return a.unionByName(b).select("batch_id", "fam", "measure", "pct", "n", "exact")


def p6_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """What the merged digests alone say of all batches: estimate and bracket."""
    return _percentiles(spark, sf)[2]


_P6_BASE = f"""WITH c0 AS (SELECT call_id, batch_id, {FAMILY_SQL} AS fam, len_bp, nbtotal, row_number() OVER (PARTITION BY call_id ORDER BY loaded_at DESC) AS rn FROM ins_calls WHERE call_id IS NOT NULL),
m AS (SELECT batch_id, fam, 'len' AS measure, len_bp AS value FROM c0 WHERE rn = 1 AND fam IS NOT NULL UNION ALL SELECT batch_id, fam, 'nbtotal', nbtotal FROM c0 WHERE rn = 1 AND fam IS NOT NULL),
v AS (SELECT * FROM m WHERE value BETWEEN {LOW} AND {HIGH}),
pc AS (SELECT CAST(unnest([50, 90]) AS INTEGER) AS pct),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_id, fam, measure ORDER BY value) AS i, count(*) OVER (PARTITION BY batch_id, fam, measure) AS n,
  row_number() OVER (PARTITION BY fam, measure ORDER BY value) AS ia, count(*) OVER (PARTITION BY fam, measure) AS na FROM v),
b AS (SELECT batch_id, fam, measure, pct, n, value AS exact FROM r, pc WHERE i = (pct * n + 99) // 100),
w AS (SELECT fam, measure, pct, na AS n, value AS exact FROM r, pc WHERE ia = (pct * na + 99) // 100)
"""


# ---- p7, p8: token counts, containers, mixes


def _token_table(spark: SparkSession, sf: str) -> DataFrame:
    return settle(count_tokens(table(spark, sf, "documents"), "text", ["doc_id", "source"]))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_token_table(spark, sf), "doc_id", "tokens", CAPACITY)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that stand in more than one container, all of their containers being within the capacity: as a text
    is cut only where it alone exceeds a container, these are the texts that must be. A container beyond the
    capacity would be an error of the packing and raises one."""
    full = F.sum("size").over(Window.partitionBy("container"))
    held = p7_containers(spark, sf).withColumn("__full", full)
    ok = F.when(F.col("__full") <= CAPACITY, F.col("container")).otherwise(F.raise_error(F.lit("a container holds more than its capacity")).cast("bigint"))
    spread = held.groupBy("doc_id", "n_pieces").agg(F.min(ok).alias("first"), F.max(ok).alias("last"), F.max("piece_no").alias("piece"))
    return spread.where("first < last and piece > 0").select("doc_id").distinct()


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per length bucket of the containers' longest items: containers, tokens and the share of space left unused."""
    filled = p7_containers(spark, sf).groupBy("container").agg(F.max("bucket").alias("bucket"), F.sum("size").alias("used"), F.count("*").alias("items"))
    return filled.groupBy("bucket").agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"),
        F.round(1 - F.sum("used") / (F.count("*") * CAPACITY), 6).alias("unused_share"),
    )


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mix(_token_table(spark, sf), table(spark, sf, "source_targets"), "doc_id", "source", "tokens")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome of each target as the draw shows it."""
    return _mixed(spark, sf)[1].select("source_name", "outcome")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


# ---- p9: subject areas


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # area_names is a fixed table of 10 rows: its names shape the model
    names = sorted({r[0] for r in fixed_rows(table(spark, sf, "area_names").where("area is not null").select(F.lower(squeeze(F.col("area")))))})
    model = ar.area_model(docs, table(spark, sf, "doc_labels"), names)
    return ar.assign_areas(docs, model)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _areas(spark, sf).select("doc_id", "area")


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, characters and mean score of each area in the corpus."""
    sizes = table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"))
    got = _areas(spark, sf).join(sizes, "doc_id")
    return got.groupBy("area").agg(F.count("*").alias("n_docs"), F.sum("chars").alias("chars"), F.round(F.avg("score"), 3).alias("mean_score"))


LLM_QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p1_text_pieces": p1_text_pieces,
    "p6_found": p6_found,
    "p6_percentiles": p6_percentiles,
    "p6_estimates": p6_estimates,
    "p7_found": p7_found,
    "p7_containers": p7_containers,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_mix": p8_mix,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

LLM_SQL: dict[str, str] = {
    "p1_found": _P1_SQL,
    "p6_found": _P6_BASE + "SELECT b.batch_id, b.fam, b.measure, b.pct FROM b JOIN w USING (fam, measure, pct) WHERE b.n >= 40 AND b.exact > 2 * w.exact",
    "p6_percentiles": _P6_BASE + "SELECT batch_id, fam, measure, pct, n, exact FROM b UNION ALL SELECT -1, fam, measure, pct, n, exact FROM w",
}
