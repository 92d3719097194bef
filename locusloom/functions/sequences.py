"""DNA sequences: expressions that stay in the JVM, and the monomer walk as an Arrow-batched function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = ("A", "G", "C", "T", "N")


def reverse_complement(seq: Column) -> Column:
    """Upper-case reverse complement; characters other than ACGTN become N."""
    up = F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")
    return F.reverse(F.translate(up, "ACGT", "TGCA"))


def base_counts(seq: Column) -> Column:
    """struct(a, g, c, t, n, total) of upper-cased bases; total counts all characters."""
    up = F.upper(seq)
    count = lambda b: (F.length(up) - F.length(F.replace(up, F.lit(b), F.lit("")))).alias(b.lower())
    return F.struct(*[count(b) for b in BASES], F.length(up).alias("total"))


def base_pct(seq: Column, base: str) -> Column:
    """Share of a base in per cent; null for an empty sequence."""
    up = F.upper(seq)
    return F.try_divide((F.length(up) - F.length(F.replace(up, F.lit(base), F.lit("")))) * F.lit(100.0), F.length(up))


def is_poly_a(seq: Column, least: float = 70.0) -> Column:
    return (base_pct(seq, "A") >= least) | (base_pct(seq, "T") >= least)


def trim_poly_a(seq: Column, least: int = 10) -> Column:
    """struct(seq, cut, tail): without a pure 3' run of at least `least` A; tail is null if there is none."""
    tail = F.regexp_extract(seq, rf"(A{{{least},}})$", 1)
    has = tail != ""
    return F.struct(F.when(has, F.substring(seq, F.lit(1), F.length(seq) - F.length(tail))).otherwise(seq).alias("seq"), F.length(tail).alias("cut"), F.when(has, tail).alias("tail"))


def trim_poly_t(seq: Column, least: int = 10) -> Column:
    """The same for a pure 5' run of T."""
    head = F.regexp_extract(seq, rf"^(T{{{least},}})", 1)
    has = head != ""
    return F.struct(F.when(has, F.substring(seq, F.length(head) + 1, F.length(seq))).otherwise(seq).alias("seq"), F.length(head).alias("cut"), F.when(has, head).alias("tail"))


def kmer_complexity(seq: Column, k: int = 4) -> Column:
    """Distinct k-mers over the sequence's length; 0 for sequences shorter than k."""
    n = F.length(seq) - k + 1
    kmers = F.regexp_extract_all(seq, F.lit(rf"(?s)(?=(.{{{k}}}))"), F.lit(1))  # one pass, where substrings would rescan
    return F.when(n > 0, F.size(F.array_distinct(kmers)) / F.length(seq)).otherwise(F.lit(0.0))


def find_monomers(seq: str, base: str, window: int = 8, max_dist: int = 2, least: int = 10, purity: float = 80.0, backward: bool = False, apply_least: bool | None = None) -> list[tuple[int, int]]:
    """Half-open [beg, end) of stretches rich in `base`.

    The sequence is tiled by `window` (from the 3' end with backward=True; a shorter rest tile never counts). A tile
    of at least `purity` per cent seeds a stretch, or extends the last one if at most max_dist tiles without it lie
    between. At both ends of a stretch single neighbouring bases equal to `base` are added. Stretches below `least`
    are left out walking backward, kept walking forward, unless apply_least says otherwise.
    """
    if not seq:
        return []
    s = seq[::-1].upper() if backward else seq.upper()
    base = base.upper()
    out: list[list[int]] = []
    last = -1
    for k in range(len(s) // window):
        tile = s[k * window : (k + 1) * window]
        if tile.count(base) * 100 >= purity * window:
            if out and k - last - 1 <= max_dist:
                out[-1][1] = (k + 1) * window
            else:
                out.append([k * window, (k + 1) * window])
            last = k
    for m in out:
        while m[0] > 0 and s[m[0] - 1] == base:
            m[0] -= 1
        while m[1] < len(s) and s[m[1]] == base:
            m[1] += 1
    if backward if apply_least is None else apply_least:
        out = [m for m in out if m[1] - m[0] >= least]
    if backward:
        return sorted((len(s) - e, len(s) - b) for b, e in out)
    return [(b, e) for b, e in out]


def monomers(seq: Column, base: str, **kw) -> Column:
    """array<struct(beg, end)> of find_monomers, in Arrow batches."""

    @F.pandas_udf("array<struct<beg:int,end:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"beg": b, "end": e} for b, e in find_monomers(x, base, **kw)] if x else [])

    return run(seq)


def end_monomers(found: Column, seq: Column, max_dist: int, least_inside: int, base: str = "A", three_prime_only: bool = False) -> Column:
    """Monomers near an end (the 3' end only if asked), and inner ones longer than least_inside of over 90 % base."""
    near3 = lambda m: F.length(seq) - m["end"] <= max_dist
    part = lambda m: F.substring(seq, m["beg"] + 1, m["end"] - m["beg"])
    inner = lambda m: (m["end"] - m["beg"] > least_inside) & (base_pct(part(m), base) > 90)
    return F.filter(found, lambda m: near3(m) | inner(m) | (F.lit(not three_prime_only) & (m["beg"] <= max_dist)))


def fetch(regions: DataFrame, chunks: DataFrame, chunk: int) -> DataFrame:
    """regions (key, ref, beg, end; half-open) with their bases, from chunks (ref, chunk_no, seq) of `chunk` bases:
    an equi-join on the chunks that a region touches, joined in order per region."""
    need = regions.where("end > beg and beg >= 0").withColumn("chunk_no", F.explode(F.expr(f"sequence(beg div {chunk}, (end - 1) div {chunk})")))
    lo = F.greatest(F.col("beg") - F.col("chunk_no") * chunk, F.lit(0))
    hi = F.least(F.col("end") - F.col("chunk_no") * chunk, F.lit(chunk))
    part = F.col("seq").substr((lo + 1).cast("int"), (hi - lo).cast("int"))
    got = need.join(chunks, ["ref", "chunk_no"]).select("key", "ref", "beg", "end", "chunk_no", part.alias("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "part"))), lambda x: x["part"]), "")
    return got.groupBy("key", "ref", "beg", "end").agg(joined.alias("seq"))


def chunked(seqs: DataFrame, chunk: int) -> DataFrame:
    """(ref, chunk_no, seq) from (ref, seq)."""
    starts = F.expr(f"transform(sequence(0, (length(seq) - 1) div {chunk}), i -> struct(cast(i as bigint) as chunk_no, substring(seq, i * {chunk} + 1, {chunk}) as seq))")
    return seqs.where("length(seq) > 0").select("ref", F.explode(starts).alias("c")).select("ref", "c.*")


def consensus(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Column-wise majority of aligned sequences per key; ties go to the lesser base, gaps (`-`) become N."""
    each = df.select(key, F.posexplode(F.split(F.upper(F.col(seq)), "")).alias("pos", "base")).where("base <> ''")
    votes = each.groupBy(key, "pos", "base").count()
    best = votes.groupBy(key, "pos").agg(F.min_by("base", F.struct(-F.col("count"), "base")).alias("base"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: F.when(x["base"] == "-", "N").otherwise(x["base"])), "")
    return best.groupBy(key).agg(text.alias("consensus"))
