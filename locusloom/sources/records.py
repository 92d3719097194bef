"""Tab-separated genomic records: a recursive-descent grammar that recovers from errors.

    text    := record (NEWLINE record)*
    record  := field (TAB field)*
    field   := quoted | bare
    quoted  := '"' (any character but '"' | '""')* '"'      followed by TAB, NEWLINE or the end
    bare    := (any character but TAB and NEWLINE)*

A record that breaks a rule yields an error with its reason and the offset where the rule broke. Parsing goes on at
the next anchor: a position after a line break where the text validates as the start of a record (its leading
fields have the form that the format asks for). The lines up to there are parsed one by one, as records or errors of
their own. A closed quote may span lines; a quote that is never closed may not
swallow the records behind it, as those begin at anchors. Where each line is delivered as a record of its own
(spans=False) a quote ends with its line at the latest.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_checked

BED, PAF = "bed", "paf"
_DIGITS = re.compile(r"[0-9]{1,18}\Z")
_ODD = re.compile(r"[^\t\x20-\x7e]")
_ANCHOR = {
    BED: re.compile(r'(?:[^\t\n"]+|"(?:[^"\n]|"")*")\t[0-9]{1,18}\t[0-9]{1,18}(?:\t|\n|\Z)'),
    PAF: re.compile(r"[^\t\n]+\t[0-9]{1,18}\t[0-9]{1,18}\t[0-9]{1,18}\t[+-]\t"),
}
_SKIP = ("#", "track", "browser")


class Broken(Exception):
    """A rule of the grammar that does not hold, with the offset where that shows."""

    def __init__(self, reason: str, at: int):
        super().__init__(reason)
        self.reason, self.at = reason, at


class RecordGrammar:
    """Recursive descent over one text; `fmt` selects the record type."""

    def __init__(self, text: str, fmt: str, multiline: bool = True, spans: bool = True):
        self.text, self.fmt, self.pos, self.multiline, self.spans = text, fmt, 0, multiline, spans

    def records(self) -> Iterator[tuple[int, list[str] | None, str | None, int]]:
        """(offset of the record, fields or None, reason or None, offset of the error or -1)."""
        n = len(self.text)
        while self.pos <= n:
            start = self.pos
            if self.skip_line():
                continue
            if start == n:
                return
            try:
                yield start, self.record(), None, -1
            except Broken as e:
                yield start, None, e.reason, e.at
                behind = self.line_end(start) + 1
                if not self.resume(max(start, 0)):
                    return
                yield from self.lines(behind, self.pos)

    def lines(self, lo: int, hi: int) -> Iterator[tuple[int, list[str] | None, str | None, int]]:
        """As `records`, of each line from lo up to hi by itself."""
        while lo < hi:
            end = self.line_end(lo)
            for off, f, reason, at in RecordGrammar(self.text[lo:end], self.fmt, multiline=False).records():
                yield lo + off, f, reason, lo + at if at >= 0 else -1
            lo = end + 1

    def skip_line(self) -> bool:
        """Consumes a line that is no record."""
        end = self.line_end(self.pos)
        line = self.text[self.pos : end]
        if self.pos < len(self.text) and (not line.strip() or line.startswith(_SKIP)):
            self.pos = end + 1
            return True
        return False

    def line_end(self, at: int) -> int:
        if not self.multiline:
            return len(self.text)
        end = self.text.find("\n", at)
        return len(self.text) if end < 0 else end

    def record(self) -> list[str]:
        end = self.line_end(self.pos)
        line = self.text[self.pos : end]
        if '"' not in line:  # a row of bare fields needs no descent
            self.pos = end + 1
            return (line[:-1] if line.endswith("\r") else line).split("\t")
        fields = [self.field()]
        while self.accept("\t"):
            fields.append(self.field())
        self.accept("\r")
        if self.pos < len(self.text) and not (self.multiline and self.accept("\n")):
            raise Broken("quoting", self.pos)
        if self.pos == len(self.text):
            self.pos += 1
        return fields

    def accept(self, what: str) -> bool:
        if self.text.startswith(what, self.pos):
            self.pos += len(what)
            return True
        return False

    def field(self) -> str:
        return self.quoted() if self.text.startswith('"', self.pos) else self.bare()

    def bare(self) -> str:
        start, end = self.pos, self.line_end(self.pos)
        tab = self.text.find("\t", start, end)
        if tab >= 0:
            self.pos = tab
        else:
            self.pos = end - 1 if end > start and self.text[end - 1] == "\r" else end
        return self.text[start : self.pos]

    def quoted(self) -> str:
        opened = self.pos
        at = opened + 1
        last = len(self.text) if self.spans else self.line_end(opened)
        parts = []
        while True:
            q = self.text.find('"', at, last)
            if q < 0:
                raise Broken("quoting", opened)
            parts.append(self.text[at:q])
            if self.text.startswith('"', q + 1):
                parts.append('"')
                at = q + 2
                continue
            break
        value = "".join(parts)
        if self.multiline and "\n" in value and self.anchor_within(opened, q):
            raise Broken("quoting", opened)
        self.pos = q + 1
        rest = self.text[self.pos : self.pos + 2]
        if rest and rest[0] not in "\t\n" and rest != "\r\n" and not (rest == "\r" and self.pos + 1 == len(self.text)):
            raise Broken("quoting", self.pos)
        return value

    def anchor_within(self, lo: int, hi: int) -> bool:
        at = self.text.find("\n", lo, hi)
        while at >= 0:
            if _ANCHOR[self.fmt].match(self.text, at + 1):
                return True
            at = self.text.find("\n", at + 1, hi)
        return False

    def resume(self, after: int) -> bool:
        """Moves to the next anchor behind `after`; without one, behind its line."""
        if not self.multiline:
            self.pos = len(self.text) + 1
            return False
        at = self.text.find("\n", after)
        first = at
        while at >= 0:
            if _ANCHOR[self.fmt].match(self.text, at + 1):
                self.pos = at + 1
                return True
            at = self.text.find("\n", at + 1)
        self.pos = first + 1 if first >= 0 else len(self.text) + 1
        return first >= 0


def _bed(f: list[str]) -> str | None:
    if len(f) != 6:
        return "columns"
    if not (_DIGITS.match(f[1]) and _DIGITS.match(f[2])):
        return "number"
    if int(f[1]) >= int(f[2]):
        return "range"
    if f[5] not in ("+", "-", "."):
        return "strand"
    return "name" if not f[3].strip() or _ODD.search(f[3]) else None


def _paf(f: list[str]) -> str | None:
    if len(f) < 12:
        return "columns"
    nums = f[1:4] + f[6:12]
    if not all(map(_DIGITS.match, nums)):
        return "number"
    q_len, q_beg, q_end, t_len, t_beg, t_end, hits, block, mapq = map(int, nums)
    if q_beg >= q_end or q_end > q_len or t_beg >= t_end or t_end > t_len or hits > block or mapq > 255:
        return "range"
    if f[4] not in ("+", "-"):
        return "strand"
    return "name" if not f[5].strip() or _ODD.search(f[5]) else None


CHECKS: dict[str, Callable[[list[str]], str | None]] = {BED: _bed, PAF: _paf}
RECORD_SCHEMA = (
    "__id bigint, fmt string, rec_no int, rec_off int, reason string, error_off int, ref_field string, beg bigint, end_pos bigint, "
    "name string, family string, strand string, q_name string, q_len bigint, q_beg bigint, q_end bigint, "
    "t_len bigint, matches bigint, block_len bigint, mapq bigint, tags array<string>"
)
_FIELDS = [p.strip().split(" ")[0] for p in RECORD_SCHEMA.split(",")]


def typed_rows(records: Iterator[tuple[int, list[str] | None, str | None, int]], fmt: str) -> Iterator[tuple]:
    """The records of a grammar as tuples of RECORD_SCHEMA behind its id and format."""
    empty = (None,) * (len(_FIELDS) - 6)
    check = CHECKS[fmt]
    for i, (off, f, reason, at) in enumerate(records):
        if reason is None:
            reason = check(f)
            at = off
        if reason is not None:
            yield (i, off, reason, at, *empty)
        elif fmt == BED:
            yield (i, off, None, None, f[0], int(f[1]), int(f[2]), f[3], f[4], f[5], *empty[6:])
        else:
            q_len, q_beg, q_end, t_len, beg, end, hits, block, mapq = map(int, f[1:4] + f[6:12])
            yield (i, off, None, None, f[5], beg, end, f[5], None, f[4], f[0], q_len, q_beg, q_end, t_len, hits, block, mapq, f[12:])


def parse_text(text: str, fmt: str, multiline: bool = True) -> Iterator[dict]:
    """Typed records and located errors of one text."""
    for row in typed_rows(RecordGrammar(text, fmt, multiline).records(), fmt):
        yield {"fmt": fmt} | {c: v for c, v in zip(_FIELDS[2:], row) if v is not None}


def parse_run(lines: list[str], fmt: str) -> Iterator[tuple[int, tuple]]:
    """(index of the line, row of `typed_rows`) of lines parsed as one text: behind an error the grammar goes on at the
    next line that validates as the start of a record, and gives the lines up to there one by one. Offsets count
    within the line. No line may hold a line break."""
    starts = list(accumulate((len(x) + 1 for x in lines), initial=0))
    for row in typed_rows(RecordGrammar("\n".join(lines), fmt, spans=False).records(), fmt):
        at = bisect_right(starts, row[1]) - 1
        yield at, (0, row[1] - starts[at], row[2], None if row[3] is None else row[3] - starts[at], *row[4:])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(v, type=_ARROW_TYPES[c]) for c, v in zip(_FIELDS, cols)], names=_FIELDS)


def _with_known_ref(parsed: DataFrame, contigs: DataFrame, id_col: str) -> DataFrame:
    """The last rule: a record's ref is exactly one of the names of a contig."""
    names = contigs.select(F.explode(F.array("ref_name", "alias_name", "accession")).alias("__n")).where("__n is not null").distinct()
    known = parsed.join(broadcast_checked(names, within=contigs), F.col("ref_field") == F.col("__n"), "left")
    bad_ref = F.col("reason").isNull() & F.col("__n").isNull()
    return (
        known.withColumn("error_off", F.when(bad_ref, F.col("rec_off")).otherwise(F.col("error_off")))
        .withColumn("reason", F.when(bad_ref, F.lit("ref")).otherwise(F.col("reason")))
        .drop("__n")
        .withColumnRenamed("__id", id_col)
    )


def _lines(df: DataFrame, id_col: str, fmt_col: str, line_col: str, *more: Column) -> DataFrame:
    rows = df.select(F.col(id_col).cast("bigint").alias("__id"), F.lower(F.trim(F.col(fmt_col))).alias("fmt"), F.col(line_col).alias("__t"), *more)
    return rows.where(F.col("fmt").isin(BED, PAF) & F.col("__t").isNotNull())


def parse_lines(df: DataFrame, contigs: DataFrame, id_col: str, fmt_col: str, line_col: str, multiline: bool = False) -> DataFrame:
    """The records of each row's text: (id, fmt, rec_no, rec_off, reason, error_off, typed columns...).

    `reason` is null for a valid record, else the first rule that fails, in the order quoting, columns, number,
    range, strand, name, ref; error_off is the character where it shows. With multiline=False (lines as received)
    a text is one line, so an error ends at the row; with True it holds many records. Null or blank texts and
    lines that start with `#`, `track` or `browser` hold no record and give no row; neither do rows of an unknown
    or null format. The rows' order, repeats and further columns do not matter. Empty input, empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, fmt, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                out.extend((i, fmt, *row) for row in typed_rows(RecordGrammar(text, fmt, multiline).records(), fmt))
            yield _batch(out)

    return _with_known_ref(_lines(df, id_col, fmt_col, line_col).mapInArrow(run, RECORD_SCHEMA), contigs, id_col)


def parse_runs(df: DataFrame, contigs: DataFrame, id_col: str, fmt_col: str, line_col: str, file_col: str, no_col: str) -> DataFrame:
    """As `parse_lines` of single lines, but lines of one file that reach a task together are parsed as one text in
    the order of their numbers (a run, bounded by the size of an Arrow batch), so that nothing is shuffled. A record
    is a line: whatever stands in a run, a line has the record or the reason that it has by itself. Lines with a line
    break inside are texts of their own. A null file or number is one of its own; ties go in order of id.
    """

    def order(i: int, no, ids) -> tuple:
        return (no is None, no or 0, ids[i] is None, ids[i] or 0, i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fmts, texts, files, nos = (b.column(i).to_pylist() for i in range(5))
            runs: dict[tuple, list[int]] = {}
            out = []
            for i, (fmt, text) in enumerate(zip(fmts, texts)):
                if "\n" in text:
                    out.extend((ids[i], fmt, *row) for row in typed_rows(RecordGrammar(text, fmt, multiline=False).records(), fmt))
                else:
                    runs.setdefault((files[i], fmt), []).append(i)
            for (_, fmt), at in runs.items():
                at.sort(key=lambda i: order(i, nos[i], ids))
                out.extend((ids[at[k]], fmt, *row) for k, row in parse_run([texts[i] for i in at], fmt))
            yield _batch(out)

    rows = _lines(df, id_col, fmt_col, line_col, F.col(file_col).cast("string").alias("__file"), F.col(no_col).cast("bigint").alias("__no"))
    return _with_known_ref(rows.mapInArrow(run, RECORD_SCHEMA), contigs, id_col)


_ARROW_TYPES = {
    c: {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}[t]
    for c, t in (p.strip().split(" ") for p in RECORD_SCHEMA.split(","))
}
