"""Typing of inserted sequences from their chain of hits. A hit is struct(tname, strand, q_beg, q_end, t_beg, t_end,
t_len), a chain an array of hits in query order; names read `kind|family|source|coordinates`, kind being consensus or
transduced (retro-elements), or `family|accession|description` (viruses)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(name: Column, i: int) -> Column:
    return F.get(F.split(name, r"\|"), F.lit(i))


def _distinct(chain: Column, i: int) -> Column:
    return F.array_sort(F.array_distinct(F.transform(chain, lambda h: part(h["tname"], i))))


def insertion_type(chain: Column) -> Column:
    """struct(ins_type, family, source): solo (consensus of one family), nested (consensus of several), orphan
    (one transduced source), partnered (consensus and transduced source of one family), else unknown."""
    kinds, families = _distinct(chain, 0), _distinct(chain, 1)
    sources = F.array_distinct(F.transform(F.filter(chain, lambda h: part(h["tname"], 0) == "transduced"), lambda h: part(h["tname"], 2)))
    only = lambda k: (F.size(kinds) == 1) & F.array_contains(kinds, k)
    kind = (
        F.when(only("consensus") & (F.size(families) == 1), "solo")
        .when(only("consensus"), "nested")
        .when(only("transduced") & (F.size(sources) == 1), "orphan")
        .when((F.size(kinds) == 2) & (F.size(families) == 1) & (F.size(sources) == 1), "partnered")
        .otherwise("unknown")
    )
    return F.struct(
        kind.alias("ins_type"), F.when(kind != "unknown", F.array_join(families, ",")).alias("family"),
        F.when(kind.isin("orphan", "partnered"), F.get(sources, F.lit(0))).alias("source"),
    )


def virus_type(chain: Column) -> Column:
    """struct(ins_type, family): one accession, several of a family, several families."""
    fam, acc = _distinct(chain, 0), _distinct(chain, 1)
    kind = F.when(F.size(acc) == 1, "viralSolo").when((F.size(acc) > 1) & (F.size(fam) == 1), "viralFamilyNested").when(F.size(fam) > 1, "viralNested").otherwise("unknown")
    return F.struct(kind.alias("ins_type"), F.array_join(fam, ",").alias("family"))


def tail_strand(poly_a: Column, poly_t: Column) -> Column:
    """Strand by total length of A-rich and T-rich ends: + or - for the larger, null for none or equal."""
    total = lambda m: F.aggregate(m, F.lit(0), lambda s, x: s + x["end"] - x["beg"])
    a, t = total(poly_a), total(poly_t)
    return F.when(a > t, "+").when(t > a, "-")


def hit_strand(chain: Column, transduced_only: Column) -> Column:
    """Strand of the hit that reaches farthest into its target; only transduced ones where asked."""
    use = F.filter(chain, lambda h: ~transduced_only | (part(h["tname"], 0) == "transduced"))
    best = F.aggregate(
        use, F.struct(F.lit(-1).cast("bigint").alias("e"), F.lit(None).cast("string").alias("s")),
        lambda s, h: F.when(h["t_end"] > s["e"], F.struct(h["t_end"].cast("bigint").alias("e"), h["strand"].alias("s"))).otherwise(s),
    )
    return best["s"]


def lengths(chain: Column, strand: Column, full_pct: float = 95.0) -> Column:
    """struct(retro_len, is_full, trunc5, trunc3, transduced_len, inversion_len) from the consensus hits' reach on
    their target, the transduced hits' query length and the hits on the other strand."""
    cons = F.filter(chain, lambda h: part(h["tname"], 0) == "consensus")
    lo = F.array_min(F.transform(cons, lambda h: h["t_beg"]))
    hi = F.array_max(F.transform(cons, lambda h: h["t_end"]))
    size = F.get(F.transform(cons, lambda h: h["t_len"]), F.lit(0))
    sum_q = lambda hs: F.aggregate(hs, F.lit(0).cast("bigint"), lambda s, h: s + h["q_end"] - h["q_beg"])
    trans = F.filter(chain, lambda h: part(h["tname"], 0) == "transduced")
    other = F.filter(cons, lambda h: h["strand"] != strand)
    return F.struct(
        (hi - lo).alias("retro_len"), (F.try_divide((hi - lo) * F.lit(100.0), size) >= full_pct).alias("is_full"), lo.alias("trunc5"), (size - hi).alias("trunc3"),
        F.when(F.size(trans) > 0, sum_q(trans)).alias("transduced_len"), F.when(F.size(other) > 0, sum_q(other)).alias("inversion_len"),
    )


def virus_lengths(chain: Column, full_pct: float = 95.0) -> Column:
    """Per hit struct(tname, viral_len, is_full, trunc5, trunc3)."""
    n = lambda h: h["t_end"] - h["t_beg"]
    return F.transform(
        chain, lambda h: F.struct(h["tname"].alias("tname"), n(h).alias("viral_len"), (F.try_divide(n(h) * F.lit(100.0), h["t_len"]) >= full_pct).alias("is_full"), h["t_beg"].alias("trunc5"), (h["t_len"] - h["t_end"]).alias("trunc3"))
    )


def mechanism(trunc3: Column, tail: Column, pct_covered: Column, most: int = 100, least_covered: float = 95.0) -> Column:
    """TPRT: 3' end kept and a tail; EI: covered, 3' end cut and no tail; else unknown."""
    kept = trunc3.isNull() | (trunc3 <= most)
    return F.when(kept & tail, "TPRT").when((pct_covered >= least_covered) & ~kept & ~tail, "EI").otherwise("unknown")


def resolved_pct(chain: Column, size: Column) -> Column:
    lo, hi = F.array_min(F.transform(chain, lambda h: h["q_beg"])), F.array_max(F.transform(chain, lambda h: h["q_end"]))
    return F.coalesce(F.try_divide((hi - lo) * F.lit(100.0), size), F.lit(0.0))


def local_share(shares: Column, least: float = 40.0) -> Column:
    """struct(found, pct): summed per cent of an insert's hits at its own site (duplication) or in the site's repeat
    families (expansion), capped at 100."""
    total = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x)
    return F.struct((total >= least).alias("found"), F.least(total, F.lit(100.0)).alias("pct"))


def pseudogene(exon_bp: Column, size: Column, tail_a: Column, tail_t: Column, least: float = 60.0) -> Column:
    """Exon bases make up `least` per cent and exactly one end carries a tail."""
    return (F.try_divide(exon_bp * F.lit(100.0), size) >= least) & (tail_a != tail_t)


def insert_type(expansion: Column, duplication: Column, interspersed: Column, pseudo: Column, virus: Column) -> Column:
    """First type of the cascade whose test holds; interspersed is a type name or null."""
    return F.when(expansion, "EXPANSION").when(duplication, "DUP").when(interspersed.isNotNull(), interspersed).when(pseudo, "PSEUDOGENE").when(virus, "VIRUS").otherwise("unknown")


def mobile_type(plus: Column, minus: Column, plus_td: Column, minus_td: Column, plus_gene: Column, minus_gene: Column) -> Column:
    """Short-read type from the majority identities of the two sides. *_td: the side's identity is a transduction;
    *_gene: it is an exon; a null identity leaves a side open.

    TD0 both sides in one element; TD1 one side transduced, the other in the element; TD2 both transduced; PSD both
    in exons; RG one side exon, the other open; UNDEFINED else with any side known, null without."""
    both = plus.isNotNull() & minus.isNotNull()
    any_ = plus.isNotNull() | minus.isNotNull()
    no = lambda x: F.coalesce(x, F.lit(False))
    p, m, pg, mg = no(plus_td), no(minus_td), no(plus_gene), no(minus_gene)
    return (
        F.when(both & p & m, "TD2")
        .when(both & pg & mg, "PSD")
        .when(both & (p != m) & ~pg & ~mg, "TD1")
        .when(both & ~p & ~m & ~pg & ~mg & (plus == minus), "TD0")
        .when(any_ & (pg != mg), "RG")
        .when(any_ & ~both & (p | m), "UNRESOLVED-TD")
        .when(any_ & ~both & ~pg & ~mg, "TD0-TD1")
        .when(any_, "UNDEFINED")
    )


def clip_text(ref_part: Column, clip_part: Column, side: Column) -> Column:
    """`ref[INT]>clip` for a right clipping, `clip<[INT]ref` for a left one."""
    return F.when(side == "right", F.concat(ref_part, F.lit("[INT]>"), clip_part)).otherwise(F.concat(clip_part, F.lit("<[INT]"), ref_part))


def interspersed_type(hits: Column, poly_tail: Column) -> Column:
    """Type of an insert by its annotated hits (array of struct(in_source, in_repeat)): a pure tail or repeats alone
    are solo, sources alone orphan, both partnered; null without any."""
    src, rep = F.exists(hits, lambda h: h["in_source"]), F.exists(hits, lambda h: h["in_repeat"])
    return F.when(poly_tail, "solo").when(src & rep, "partnered").when(src, "orphan").when(rep, "solo")


def short_read_tail(seq: Column, least: int = 8) -> Column:
    """struct(poly_a, poly_t): a 3' run of A, a 5' run of T, of at least `least` bases with one other base allowed
    inside."""
    return F.struct(seq.rlike(rf"A{{{least // 2},}}[ACGT]?A{{{least - least // 2},}}$").alias("poly_a"), seq.rlike(rf"^T{{{least // 2},}}[ACGT]?T{{{least - least // 2},}}").alias("poly_t"))


def tail_length(tails: Column, size: Column, within: int = 30) -> Column:
    """Length of the last A-rich stretch (array of struct(beg, end)) that ends within `within` of the 3' end, else 0."""
    near = F.filter(tails, lambda m: size - m["end"] <= within)
    last = F.get(near, F.size(near) - 1)
    return F.coalesce(last["end"] - last["beg"], F.lit(0))


def tandem_repeat(chain: Column, size: Column, least: float) -> Column:
    """struct(is_tandem, pct, n_motifs, motifs) of a chain of tandem-repeat calls (struct(beg, end, motif))."""
    lo, hi = F.get(chain, F.lit(0))["beg"], F.get(chain, F.size(chain) - 1)["end"]
    pct = F.coalesce(F.try_divide((hi - lo) * F.lit(100.0), size), F.lit(0.0))
    motifs = F.array_sort(F.array_distinct(F.transform(chain, lambda h: h["motif"])))
    return F.struct((pct >= least).alias("is_tandem"), pct.alias("pct"), F.size(motifs).alias("n_motifs"), motifs.alias("motifs"))


def hexamer_calls(calls: Column, size: Column, strand: Column, edge: int = 300, rich: float = 60.0) -> Column:
    """Repeat calls (struct(beg, end, a, c, g, t)) that can be the hexamer of a composite element: rich in C and T
    within `edge` of the 5' end on strand +, rich in G and A within `edge` of the 3' end on -."""
    return F.filter(calls, lambda h: F.when(strand == "+", (h["c"] + h["t"] >= rich) & (h["beg"] <= edge)).otherwise((h["g"] + h["a"] >= rich) & (size - h["end"] <= edge)))


def cut_out(seq: Column, beg: Column, end: Column) -> Column:
    return F.concat(F.substring(seq, F.lit(1), beg), F.substring(seq, end + 1, F.length(seq)))
