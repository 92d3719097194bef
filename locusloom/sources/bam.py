"""Binary alignment files as the table that `formats.read_sam` gives.

A BAM file is a chain of gzip members around one stream: a header with the names of the references, then records of
fixed fields, name, CIGAR, packed bases, qualities and tags, little-endian throughout.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes of bases and of CIGAR operations, and the sizes of fixed-width tag values (fixed values of the format).
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_PAIRS = [a + b for a in BASES for b in BASES]
_FIXED = struct.Struct("<iiBBHHHiiii")
_RAW = "read_name string, flag int, ref string, pos bigint, mapq int, cigar string, mate_ref string, mate_pos bigint, tlen bigint, seq string, qual string, sa string"
_NAMES = [p.strip().split(" ")[0] for p in _RAW.split(",")]
_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
_SCHEMA = pa.schema([(p.strip().split(" ")[0], _TYPES[p.strip().split(" ")[1]]) for p in _RAW.split(",")])
#: Records that leave a task together, and the compressed bytes that are inflated at a time.
BATCH, STEP = 8192, 1 << 20


class _Stream:
    """Reads exact numbers of bytes of the inflated members, holding little more than what was asked for."""

    def __init__(self, content: bytes):
        self.content, self.at, self.z, self.buf, self.off = memoryview(content), 0, zlib.decompressobj(31), b"", 0

    def read(self, n: int) -> bytes:
        while len(self.buf) - self.off < n:
            more = self._inflate()
            if not more:
                if len(self.buf) > self.off:
                    raise ValueError("the file ends inside a record")
                return b""
            self.buf, self.off = self.buf[self.off :] + more, 0
        got = self.buf[self.off : self.off + n]
        self.off += n
        return got

    def _inflate(self) -> bytes:
        while True:
            if self.z.eof:
                rest = self.z.unused_data
                self.at -= len(rest)
                self.z = zlib.decompressobj(31)
            if self.at >= len(self.content):
                return b""
            part = self.content[self.at : self.at + STEP]
            self.at += len(part)
            out = self.z.decompress(part)
            if out:
                return out


def _supplementary(tags: memoryview) -> str | None:
    """The text of the SA tag among a record's tags."""
    at, n = 0, len(tags)
    while at + 3 <= n:
        name, kind = bytes(tags[at : at + 2]), chr(tags[at + 2])
        at += 3
        if kind in "ZH":
            end = bytes(tags[at:]).index(0) + at
            if name == b"SA":
                return bytes(tags[at:end]).decode()
            at = end + 1
        elif kind == "B":
            at += 5 + TAG_SIZES[chr(tags[at])] * struct.unpack_from("<i", tags, at + 1)[0]
        else:
            at += TAG_SIZES[kind]
    return None


def records(content: bytes, ref: str | None = None, beg: int | None = None, end: int | None = None) -> Iterator[tuple]:
    """Rows of _RAW. Records outside the region (ref; begin up to `end`; for `beg`, see `read_bam`) are passed over
    before their names, bases and tags are decoded."""
    s = _Stream(content)
    if s.read(4) != b"BAM\1":
        raise ValueError("no BAM file")
    s.read(struct.unpack("<i", s.read(4))[0])
    refs = []
    for _ in range(struct.unpack("<i", s.read(4))[0]):
        refs.append(s.read(struct.unpack("<i", s.read(4))[0])[:-1].decode())
        s.read(4)
    name_of = lambda i: refs[i] if i >= 0 else "*"
    while head := s.read(4):
        r = s.read(struct.unpack("<i", head)[0])
        ref_id, pos, n_name, mapq, _, n_ops, flag, n_seq, mate_id, mate_pos, tlen = _FIXED.unpack_from(r)
        if ref is not None and name_of(ref_id) != ref or end is not None and pos > end:
            continue
        at = _FIXED.size
        name = r[at : at + n_name - 1].decode()
        at += n_name
        ops = struct.unpack_from(f"<{n_ops}I", r, at)
        if beg is not None and pos + sum(o >> 4 for o in ops if OPERATIONS[o & 15] in "MDN=X") < beg:
            continue
        at += 4 * n_ops
        packed = (n_seq + 1) // 2
        seq = "".join(map(_PAIRS.__getitem__, r[at : at + packed]))[:n_seq]
        at += packed
        qual = r[at : at + n_seq]
        at += n_seq
        cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops)
        mate = "=" if mate_id == ref_id and mate_id >= 0 else name_of(mate_id)
        text = "*" if not n_seq or qual[0] == 255 else qual.translate(_PHRED).decode()
        yield name, flag, name_of(ref_id), pos, mapq, cigar or "*", mate, mate_pos, tlen, seq or "*", text, _supplementary(memoryview(r)[at:])


_PHRED = bytes(min(q + 33, 126) for q in range(256))


def read_bam(spark: SparkSession, path: str, ref: str | None = None, beg: int | None = None, end: int | None = None) -> DataFrame:
    """The columns of `formats.read_sam`, of all alignments or of those that touch a region [beg, end].

    A file is read by one task and has to be below 2 GB, the most that a value can hold (larger ones raise an
    error); many files spread over tasks. `events.ingest` turns alignments into a table whose scans split and skip by
    region, which is what repeated scans should read.
    """
    from .formats import alignment_columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                held: list[tuple] = []
                for row in records(content.as_buffer().to_pybytes(), ref, beg, end):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bam").load(path).select("content")
    return alignment_columns(files.mapInArrow(run, _RAW))
