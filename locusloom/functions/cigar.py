"""CIGAR strings as Spark expressions; an operation is struct(n int, op string)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that consume the reference, the read's bases shown, and the read as sequenced (fixed by the SAM format).
ON_REF, ON_QUERY, ON_READ = "M=XDN", "M=XI", "M=XISH"


def cigar_ops(cigar: Column | str) -> Column:
    """array<struct<n, op>>; a null or empty text, or `*`, gives an empty array."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    parts = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def _span(ops: Column, kinds: str) -> Column:
    return F.aggregate(ops, F.lit(0), lambda s, o: s + F.when(o["op"].isin(*kinds), o["n"]).otherwise(0))


def ref_span(ops: Column) -> Column:
    """Reference bases covered."""
    return _span(ops, ON_REF)


def query_span(ops: Column) -> Column:
    return _span(ops, ON_QUERY)


def read_length(ops: Column) -> Column:
    return _span(ops, ON_READ)


def is_clip(op: Column) -> Column:
    return op["op"].isin("S", "H")


def left_clip(ops: Column) -> Column:
    """Length of a leading S or H; 0 without one."""
    first = F.get(ops, F.lit(0))
    return F.coalesce(F.when(is_clip(first), first["n"]), F.lit(0))


def right_clip(ops: Column) -> Column:
    last = F.get(ops, F.size(ops) - 1)
    return F.coalesce(F.when(is_clip(last) & (F.size(ops) > 1), last["n"]), F.lit(0))


def query_interval(ops: Column, strand: Column | str) -> Column:
    """struct(beg, end) of the aligned part in the read's own direction: mirrored for strand `-`."""
    s = F.lit(strand) if isinstance(strand, str) else strand
    beg = left_clip(ops)
    end = beg + query_span(ops)
    total = read_length(ops)
    return F.when(s == "-", F.struct((total - end).alias("beg"), (total - beg).alias("end"))).otherwise(F.struct(beg.alias("beg"), end.alias("end")))


def clipping_type(ops: Column, side: Column | str) -> Column:
    s = F.lit(side) if isinstance(side, str) else side
    op = F.when(s == "left", F.get(ops, F.lit(0))["op"]).otherwise(F.get(ops, F.size(ops) - 1)["op"])
    return F.when(op == "S", "soft").otherwise("hard")


def indels(df: DataFrame, ops: str, beg: str, least: int) -> DataFrame:
    """df with one row per insertion or deletion of at least `least` bases: (sv_type, ref_pos, ref_end, read_pos, n).

    Offsets are prefix sums over the operations of one read, folded in place: no shuffle."""
    state = "struct(cast({b} as bigint) as r, cast(0 as bigint) as q, cast(array() as array<struct<sv_type:string,ref_pos:bigint,ref_end:bigint,read_pos:bigint,n:int>>) as found)"
    fold = f"""aggregate({ops}, {state.format(b=beg)}, (s, o) -> struct(
        s.r + if(o.op in ('M', '=', 'X', 'D', 'N'), o.n, 0) as r,
        s.q + if(o.op in ('M', '=', 'X', 'I', 'S'), o.n, 0) as q,
        concat(s.found, if(o.op in ('I', 'D') and o.n >= {least},
            array(struct(if(o.op = 'I', 'INS', 'DEL') as sv_type, s.r as ref_pos, s.r + if(o.op = 'D', o.n, 0) as ref_end, s.q as read_pos, o.n as n)),
            cast(array() as array<struct<sv_type:string,ref_pos:bigint,ref_end:bigint,read_pos:bigint,n:int>>))) as found), s -> s.found)"""
    return df.withColumn("__i", F.explode(F.expr(fold))).select(*df.columns, "__i.*")


def blocks(df: DataFrame, ops: str, beg: str) -> DataFrame:
    """df with one row per block of a spliced alignment (block_no, block_beg, block_end): N splits, every other
    operation, also I and S, extends the block."""
    fold = f"""aggregate({ops}, struct(cast({beg} as bigint) as b, cast({beg} as bigint) as e, cast(array() as array<struct<block_beg:bigint,block_end:bigint>>) as done), (s, o) ->
        if(o.op = 'N', struct(s.e + o.n as b, s.e + o.n as e, if(s.e > s.b, concat(s.done, array(struct(s.b as block_beg, s.e as block_end))), s.done) as done),
           struct(s.b as b, s.e + o.n as e, s.done as done)),
        s -> if(s.e > s.b, concat(s.done, array(struct(s.b as block_beg, s.e as block_end))), s.done))"""
    return df.select("*", F.posexplode(F.expr(fold)).alias("block_no", "__b")).select(*df.columns, "block_no", "__b.*")


def clip_events(df: DataFrame, ops: str, beg: str, end: str, least: int) -> DataFrame:
    """df with one row per end that is clipped by at least `least` bases: (clipped_side, clip_pos, clip_len)."""
    o = F.col(ops)
    made = F.array(
        F.when(left_clip(o) >= least, F.struct(F.lit("left").alias("clipped_side"), F.col(beg).cast("bigint").alias("clip_pos"), left_clip(o).alias("clip_len"))),
        F.when(right_clip(o) >= least, F.struct(F.lit("right").alias("clipped_side"), F.col(end).cast("bigint").alias("clip_pos"), right_clip(o).alias("clip_len"))),
    )
    return df.withColumn("__c", F.explode(F.array_compact(made))).select(*df.columns, "__c.*")


def parse_sa(sa: Column) -> Column:
    """SA tag text -> array<struct(ref, beg, strand, cigar, mapq, nm, end)>; beg as the tag states
    it, end = beg + reference span."""
    items = F.filter(F.split(F.coalesce(sa, F.lit("")), ";"), lambda x: x != "")

    def one(x):
        f = F.split(x, ",")
        beg = F.get(f, F.lit(1)).try_cast("bigint")
        span = ref_span(cigar_ops(F.get(f, F.lit(3))))
        return F.struct(
            F.get(f, F.lit(0)).alias("ref"), beg.alias("beg"), F.get(f, F.lit(2)).alias("strand"), F.get(f, F.lit(3)).alias("cigar"),
            F.get(f, F.lit(4)).try_cast("int").alias("mapq"), F.get(f, F.lit(5)).try_cast("int").alias("nm"), (beg + span).alias("end"),
        )

    return F.transform(items, one)


def phred_text(quals: Column) -> Column:
    """Phred scores (array<int>) as text, each score + 33 as a character."""
    return F.array_join(F.transform(quals, lambda q: F.char(q + 33)), "")


def swap_mate(df: DataFrame, own: list[str], mate: list[str]) -> DataFrame:
    """Each row with its own and its mate's columns exchanged, pairwise."""
    swap = {**dict(zip(own, mate)), **dict(zip(mate, own))}
    return df.select(*[F.col(swap.get(x, x)).alias(x) for x in df.columns])


def flank(seq: Column, pos: Column, length: Column, kind: str, overhang: int) -> Column:
    """struct(seq, pos): bases around an event in its read. kind: ins (the insert and overhang on both sides), del
    (overhang on both sides), left or right (a clipping's breakpoint with the aligned side cut to overhang)."""
    lo = F.greatest(pos - overhang, F.lit(0))
    if kind == "ins":
        return F.struct(seq.substr(lo + 1, pos + length + overhang - lo).alias("seq"), (pos - lo).alias("pos"))
    if kind == "del":
        return F.struct(seq.substr(lo + 1, pos + overhang - lo).alias("seq"), F.lit(overhang).alias("pos"))
    if kind == "left":
        return F.struct(seq.substr(F.lit(1), pos + overhang).alias("seq"), pos.alias("pos"))
    return F.struct(seq.substr(lo + 1, F.length(seq)).alias("seq"), (pos - lo).alias("pos"))
