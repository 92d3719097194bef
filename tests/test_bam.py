"""A BAM file gives the rows of the SAM text with the same alignments."""

import gzip
import random
import struct

import pytest

from locusloom.operators.events import in_region
from locusloom.sources import bam
from locusloom.sources.formats import read_sam

REFS = ["chr1", "chr2"]


def encode(rows, member=700):
    """BAM bytes of SAM rows, in small members so that records cross them."""
    out = b"BAM\1" + struct.pack("<i", 3) + b"@HD" + struct.pack("<i", len(REFS)) + b"".join(struct.pack("<i", len(r) + 1) + r.encode() + b"\0" + struct.pack("<i", 10**6) for r in REFS)
    at = lambda r: REFS.index(r) if r in REFS else -1
    for name, flag, ref, pos, mapq, cigar, mate, mpos, tlen, seq, qual, *tags in rows:
        ops, n = [], ""
        for c in cigar if cigar != "*" else "":
            if c.isdigit():
                n += c
            else:
                ops.append(int(n) << 4 | bam.OPERATIONS.index(c))
                n = ""
        bases = "" if seq == "*" else seq
        code = [bam.BASES.index(c) for c in bases] + [0] * (len(bases) % 2)
        packed = bytes(a << 4 | b for a, b in zip(code[::2], code[1::2]))
        q = bytes([255] * len(bases)) if qual == "*" else bytes(ord(c) - 33 for c in qual)
        extra = b""
        for t in tags:
            k, kind, v = t.split(":", 2)
            extra += k.encode() + kind.encode() + (v.encode() + b"\0" if kind == "Z" else struct.pack("<i", int(v)) if kind == "i" else b"S" + struct.pack("<iHH", 2, 1, 2))
        mate_id = at(ref) if mate == "=" else at(mate)
        body = struct.pack("<iiBBHHHiiii", at(ref), pos - 1, len(name) + 1, mapq, 0, len(ops), flag, len(bases), mate_id, mpos - 1, tlen) + name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + q + extra
        out += struct.pack("<i", len(body)) + body
    return b"".join(gzip.compress(out[i : i + member]) for i in range(0, len(out), member)) + gzip.compress(b"")


def alignments(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        m, k = rng.randint(1, 60), rng.randint(0, 9)
        cigar, size = (f"{k}S{m}M3D2I", k + m + 2) if k else (f"{m}M", m)
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        tags = rng.choice([(), ("NM:i:3", "SA:Z:chr2,5,+,4M,60,0;"), ("XB:B:S,1,2", "SA:Z:chr1,9,-,7M,1,1;")])
        rows.append((f"r{i}", rng.choice([0, 16, 1 | 64, 1024, 2048 | 16]), rng.choice(REFS), rng.randint(1, 5000), rng.randint(0, 60), cigar, rng.choice(["=", "*", "chr2"]), rng.randint(1, 99), rng.randint(-500, 500), seq, "*" if i % 7 == 0 else "I" * size, *tags))
    rows.append(("u", 4, "*", 0, 0, "*", "*", 0, 0, "*", "*"))
    # the text has `=` for a mate on the same reference
    return [(*r[:6], "=" if r[6] == r[2] and r[2] != "*" else r[6], *r[7:]) for r in rows]


def test_bam_equals_sam(spark, tmp_path):
    rows = alignments(1)
    for i in range(2):
        (tmp_path / f"{i}.bam").write_bytes(encode(rows[i::2]))
    (tmp_path / "other.txt").write_text("no alignments")
    (tmp_path / "t.sam").write_text("@HD\n" + "\n".join("\t".join(map(str, [x for x in r if not str(x).startswith("XB")])) for r in rows) + "\n")
    sam, got = read_sam(spark, str(tmp_path / "t.sam")), bam.read_bam(spark, str(tmp_path))
    assert got.schema.simpleString() == sam.schema.simpleString()
    key = lambda r: r["read_name"]
    assert sorted(got.collect(), key=key) == sorted(sam.collect(), key=key) and got.count() == len(rows)
    region = bam.read_bam(spark, str(tmp_path), "chr1", 1000, 2500)
    assert sorted(region.collect(), key=key) == sorted(in_region(sam, "chr1", 1000, 2500).collect(), key=key)


def test_damaged_files_raise():
    whole = encode(alignments(2, 20))
    with pytest.raises(ValueError, match="no BAM"):
        list(bam.records(gzip.compress(b"text text")))
    with pytest.raises(ValueError, match="inside a record"):
        list(bam.records(gzip.compress(gzip.decompress(whole)[:-7])))
    assert list(bam.records(encode([]))) == []
