"""Cutting oversized items at natural boundaries, with an overlap between consecutive pieces.

The cut is one regular expression with bounded quantifiers. Its alternatives, strongest boundary first, consume up
to the step (limit - overlap) and must end at a boundary of their strength; the last one takes any character. The
cores it extracts tile the text, and lookback offsets over the array of cores add the overlap. Items that have only
a length and a list of boundary intervals (no text to match) go through the same greedy rule over positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zero-width tests of a cut position, by kind of text, strongest first.
PROSE = (r"(?<=\n\n)", r"(?<=\n)", r"(?<=[.!?] )", r"(?<=\s)")


def run_boundary(char: str, least: int) -> str:
    """A cut position inside, or at either end of, a run of at least `least` times `char`."""
    inside = "|".join(f"(?<={char}{{{i}}})(?={char}{{{least - i}}})" for i in range(1, least))
    return f"(?:(?<={char}{{{least}}})|(?={char}{{{least}}})" + (f"|(?<={char})(?={char})(?:{inside}))" if inside else ")")


def cut_pattern(step: int, boundaries: tuple[str, ...], least: int = 1) -> str:
    """Group 1: the rest of the text; groups 2..: an end at boundary 1..; the last group: a forced end.

    `least` is the shortest core that a boundary may make, so that a strong one near the start leaves no crumb.
    """
    any_char = r"[\s\S]"
    least = max(1, min(least, step))
    ends = [rf"({any_char}{{{least},{step}}}(?:{b}))" for b in boundaries]
    return "|".join([rf"({any_char}{{1,{step}}}+\z)", *ends, rf"({any_char}{{1,{step}}})"])


def cut_cores(text: Column, limit: int, overlap: int, boundaries: tuple[str, ...], least: int = 1) -> tuple[Column, Column]:
    """(cores, forced): the tiles of the text and, per tile, whether it ends where no boundary is."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    pattern = F.lit(cut_pattern(limit - overlap, boundaries, least))
    cores = F.regexp_extract_all(text, pattern, F.lit(0))
    forced = F.transform(F.regexp_extract_all(text, pattern, F.lit(len(boundaries) + 2)), lambda g: g != "")
    return cores, forced


#: Tiles whose offsets are summed together; sums of blocks keep an item of many tiles from quadratic copying.
BLOCK = 256


def running_offsets(sizes: Column) -> Column:
    """[0, s1, s1 + s2, ...] of an array of integers, by sums inside blocks of BLOCK and over the blocks."""
    zero = F.lit(0).cast("bigint")
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    plus = lambda acc, x: acc + x
    numbers = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    blocks = F.transform(numbers, lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    starts = F.aggregate(F.transform(blocks, lambda x: F.aggregate(x, zero, plus)), F.array(zero), add)
    inner = F.transform(blocks, lambda x, i: F.slice(F.aggregate(x, F.array(F.get(starts, i)), add), F.lit(2), F.lit(BLOCK)))
    return F.concat(F.array(zero), F.flatten(inner))


def split_text(
    df: DataFrame,
    id_col: str,
    text_col: str,
    limit: int,
    overlap: int,
    boundaries: tuple[str, ...] = PROSE,
    least: int = 1,
) -> DataFrame:
    """Rows (id, piece_no, beg, end_pos, piece, forced) for every item longer than the limit.

    beg and end_pos are character offsets, half-open; a piece holds at most `limit` characters and, but for the
    first, starts with the last `overlap` characters of the piece before. forced: the piece ends at no boundary.
    Null and empty texts and those within the limit give no rows. A null id is kept as it is. Repeated rows are
    cut once each. Columns other than id and text are not read. Empty input, empty result.
    """
    src = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).where(F.length("__t") > limit)
    cores, forced = cut_cores(F.col("__t"), limit, overlap, boundaries, least)
    tiled = src.select("__id", "__t", cores.alias("__c"), forced.alias("__f"))
    tiled = tiled.withColumn("__o", running_offsets(F.transform("__c", lambda x: F.length(x).cast("bigint"))))

    def piece(i):
        # the lookback usually lies in the tile before; only tiles shorter than the overlap need the text again
        back = F.when(
            F.length(F.get("__c", i - 1)) >= overlap, F.right(F.get("__c", i - 1), F.lit(overlap))
        ).otherwise(F.col("__t").substr((F.greatest(F.get("__o", i) - overlap, F.lit(0)) + 1).cast("int"), F.least(F.get("__o", i), F.lit(overlap)).cast("int")))
        return F.struct(
            i.cast("int").alias("piece_no"),
            F.greatest(F.get("__o", i) - F.when(i > 0, F.lit(overlap)).otherwise(F.lit(0)), F.lit(0)).alias("beg"),
            F.get("__o", i + 1).alias("end_pos"),
            F.concat(F.when(i > 0, back).otherwise(F.lit("")), F.get("__c", i)).alias("piece"),
            F.get("__f", i).alias("forced"),
        )

    pieces = F.transform(F.sequence(F.lit(0), F.size("__c") - 1), piece)
    return tiled.select("__id", F.explode(pieces).alias("p")).select(F.col("__id").alias(id_col), "p.*")


def interval_cuts(length: Column, gaps: Column, limit: int, overlap: int) -> Column:
    """Array of (pos, forced): where an item of `length` must be cut so that no core exceeds limit - overlap.

    `gaps` is the array of struct(gb, ge) of natural boundaries, disjoint and ordered. Each cut is the farthest
    position within reach inside a gap; where none is in reach, the cut is forced at the full step. A null array
    counts as empty; a null length gives null.
    """
    step = limit - overlap
    cut_type = "array<struct<pos:bigint,forced:boolean>>"
    ends = F.concat(
        F.coalesce(gaps, F.expr("cast(array() as array<struct<gb:bigint,ge:bigint>>)")),
        F.array(F.struct(length.cast("bigint").alias("gb"), length.cast("bigint").alias("ge"))),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("best"), F.expr(f"cast(array() as {cut_type})").alias("cuts"))

    def let(value, body):
        return F.transform(F.array(value), body)[0]

    def cuts_at(first, n, forced):
        """n cuts, one step apart, the first a step behind `first`."""
        made = F.transform(
            F.sequence(F.lit(1).cast("bigint"), n), lambda j: F.struct((first + j * step).alias("pos"), F.lit(forced).alias("forced"))
        )
        return F.when(n > 0, made).otherwise(F.expr(f"cast(array() as {cut_type})"))

    def steps_before(span):
        """Whole steps that leave at most one step of `span`."""
        return F.greatest(F.lit(0).cast("bigint"), F.floor((span - 1) / step))

    def to_best(s, g):
        go = (g["gb"] > s["p"] + step) & (s["best"] > s["p"])
        return F.when(
            go,
            F.struct(s["best"].alias("p"), s["best"].alias("best"), F.concat(s["cuts"], F.array(F.struct(s["best"].alias("pos"), F.lit(False).alias("forced")))).alias("cuts")),
        ).otherwise(s)

    def to_gap(s, g):
        n = steps_before(g["gb"] - s["p"])
        return F.struct((s["p"] + n * step).alias("p"), s["best"].alias("best"), F.concat(s["cuts"], cuts_at(s["p"], n, True)).alias("cuts"))

    def through_gap(s, g):
        n = steps_before(g["ge"] - s["p"])
        return F.struct((s["p"] + n * step).alias("p"), g["ge"].alias("best"), F.concat(s["cuts"], cuts_at(s["p"], n, False)).alias("cuts"))

    def one(s, g):
        return let(to_best(s, g), lambda s1: let(to_gap(s1, g), lambda s2: through_gap(s2, g)))

    return F.aggregate(ends, start, one, lambda s: s["cuts"])
