"""Haplotypes as long tables (seq_id, pos, state)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def snp_code(ref: Column, alt: Column) -> Column:
    """1 to 12 by substitution, bases in the order A, C, G, T; null for anything else."""
    order = "ACGT"
    codes = [(r, a) for r in order for a in order if r != a]
    out = F.lit(None).cast("int")
    for i, (r, a) in enumerate(codes, 1):
        out = F.when((F.upper(ref) == r) & (F.upper(alt) == a), i).otherwise(out)
    return out


def indel_code(ref: Column, alt: Column) -> Column:
    """`-REF` for a deletion, `+ALT` for an insertion, null for equal lengths."""
    return F.when(F.length(ref) > F.length(alt), F.concat(F.lit("-"), ref)).when(F.length(ref) < F.length(alt), F.concat(F.lit("+"), alt))


def haplotype_states(variants: DataFrame, length: int, kind: str = "snp") -> DataFrame:
    """(seq_id, pos, state): a row for every position 1 .. length of each sequence with variants (seq_id, pos, ref,
    alt): the substitution's code, or with kind `indel` the change as text, and `0` where there is none. Of several
    variants at a position the least text stands; positions outside and other kinds of variants are left out, but their
    sequences keep their rows."""
    code = snp_code(F.col("ref"), F.col("alt")).cast("string") if kind == "snp" else indel_code(F.col("ref"), F.col("alt"))
    per = variants.groupBy("seq_id", F.col("pos").cast("int").alias("pos")).agg(F.min(code).alias("s"))
    entry = F.when(F.col("s").isNotNull() & F.col("pos").between(1, length), F.struct("pos", "s"))
    maps = per.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    rows = maps.select("seq_id", "m", F.explode(F.sequence(F.lit(1), F.lit(length))).alias("pos"))
    return rows.select("seq_id", "pos", F.coalesce(F.try_element_at("m", F.col("pos")), F.lit("0")).alias("state"))


def diagnostic_scores(states: DataFrame, pos: str = "pos", state: str = "state") -> DataFrame:
    """(pos, state, score): 1 - the share of the state at its position."""
    n = states.groupBy(pos, state).agg(F.count("*").alias("__n"))
    return n.select(pos, state, (1 - F.col("__n") / F.sum("__n").over(Window.partitionBy(pos))).alias("score"))


def informative(scores: DataFrame, pos: str = "pos") -> DataFrame:
    """Positions at which some state scores."""
    return scores.groupBy(pos).agg(F.max("score").alias("__m")).where("__m <> 0").select(pos)


#: Targets and references that meet in one cell of `compare`.
BLOCK = 2048


def compare(targets: DataFrame, refs: DataFrame, scores: DataFrame, block: int = BLOCK) -> DataFrame:
    """(target, ref_id, score): targets and refs are (seq_id, pos, state); every position adds the reference state's
    score if the states agree and takes it off if not, over the sum of scores; rescaled to 0 .. 1 (which leaves the
    agreeing share of the sum) in two decimals, halves up with a margin for the order of summation. A pair that agrees
    nowhere scores 0; references whose scores sum to 0 are left out, as are states without a score.

    Meant for a stated set of targets against all references, in blocks: both sides become one sparse row per
    sequence, hashed into blocks of about `block`; a cell of the grid of blocks is one product of two matrices, so
    what is shuffled grows with the blocks of the other side and no position or state gathers all rows.
    """
    state = F.struct(F.col("pos").cast("bigint").alias("p"), F.col("state").cast("bigint").alias("s"))
    r = refs.join(scores, ["pos", "state"]).groupBy(F.col("seq_id").alias("id")).agg(F.sum("score").alias("all"), F.collect_list(F.struct(state.alias("k"), "score")).alias("x")).where("all > 0")
    t = targets.groupBy(F.col("seq_id").alias("id")).agg(F.collect_list(F.struct(state.alias("k"), F.lit(1.0).alias("score"))).alias("x"))
    t, r = settle(t), settle(r)
    nt, nr = max(1, -(-t.count() // block)), max(1, -(-r.count() // block))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = t.select(own(nt).alias("i"), every(nr).alias("j"), "id", "x.k.p", "x.k.s", F.col("x.score").alias("w"), F.lit(1.0).alias("all"))
    right = r.select(every(nt).alias("i"), own(nr).alias("j"), "id", "x.k.p", "x.k.s", F.col("x.score").alias("w"), "all")
    id_type = dict(t.dtypes)["id"]

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        ids = pa.array([], type=a.schema.field("id").type)
        if not (a.num_rows and b.num_rows):
            return pa.table({"target": ids, "ref_id": ids, "hit": pa.array([], pa.float64()), "all": pa.array([], pa.float64())})
        (ia, ka, wa), (ib, kb, wb) = _sparse(a), _sparse(b)
        keys, at = np.unique(np.concatenate([ka, kb]), return_inverse=True)
        x, y = np.zeros((a.num_rows, len(keys))), np.zeros((b.num_rows, len(keys)))
        np.add.at(x, (ia, at[: len(ka)]), wa)
        np.add.at(y, (ib, at[len(ka) :]), wb)
        hit = x @ y.T
        n, m = hit.shape
        return pa.table({
            "target": a.column("id").take(pa.array(np.repeat(np.arange(n), m))), "ref_id": b.column("id").take(pa.array(np.tile(np.arange(m), n))),
            "hit": pa.array(hit.ravel()), "all": pa.array(np.tile(b.column("all").to_numpy(), n)),
        })

    got = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, f"target {id_type}, ref_id {id_type}, hit double, all double")
    return got.select("target", "ref_id", (F.floor(F.expr("hit / all * 100 + 0.500001")) / 100.0).alias("score"))


def _sparse(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code of position and state, weight) of every entry."""
    lists = [t.column(c).combine_chunks() for c in ("p", "s", "w")]
    row = np.repeat(np.arange(t.num_rows), [len(v) for v in lists[0]])
    p, s, w = (v.flatten().to_numpy(zero_copy_only=False) for v in lists)
    return row, p * (1 << 32) + s, w


def assign(compared: DataFrame, least: float = 0.08) -> DataFrame:
    """(target, ref_id, best, second, log_ratio): the reference of the single best score, if log2(best / second
    distinct score) reaches `least`."""
    w = Window.partitionBy("target").orderBy(F.desc("score"))
    ranked = compared.withColumn("__r", F.dense_rank().over(w)).where("__r <= 2")
    g = ranked.groupBy("target").agg(
        F.max("score").alias("best"), F.min(F.when(F.col("__r") == 2, F.col("score"))).alias("second"), F.count_if(F.col("__r") == 1).alias("__n"), F.min(F.when(F.col("__r") == 1, F.col("ref_id"))).alias("ref_id")
    )
    ratio = F.when(F.col("second") > 0, F.log2(F.col("best") / F.col("second")))
    return g.withColumn("log_ratio", ratio).where((F.col("__n") == 1) & (F.col("log_ratio") >= least)).select("target", "ref_id", "best", "second", "log_ratio")
