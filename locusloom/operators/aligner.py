"""Alignment of sequences: a hook for an aligner of the caller's choice, and one from k-mers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Preset of an aligner by sequencing technology (fixed values).
PRESETS = {"PACBIO": "map-pb", "NANOPORE": "map-ont", "ILLUMINA": "sr", "HIFI": "map-hifi"}
PAF_SCHEMA = (
    "q_name string, q_len bigint, q_beg bigint, q_end bigint, strand string, t_name string, t_len bigint, t_beg bigint, t_end bigint, matches bigint, block_len bigint, mapq bigint"
)


def preset(technology: str) -> str:
    if technology not in PRESETS:
        raise ValueError(f"no preset for {technology!r}; known: {', '.join(PRESETS)}")
    return PRESETS[technology]


def align_with(seqs: DataFrame, aligner: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """PAF rows of (seq_id, seq) from a function over batches of them, e.g. around an installed aligner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield aligner(b)

    return seqs.select("seq_id", "seq").mapInPandas(run, PAF_SCHEMA)


#: Bases of a block of sequences; places, k-mers or hits looked at in one step, few enough for a cache.
BLOCK, STEP = 12 << 20, 1 << 17
#: Letters of a k-mer that one sort compares; longer ones are put together from such parts.
PART = 16
_BLOCK_SCHEMA = "block bigint, names array<string>, lens array<bigint>, bases binary, bad binary"
_CODE = np.full(256, 4, np.uint8)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = range(4)  # a base and its complement add up to 3
_BASES = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3).astype(np.uint8)


def _pack(block: int, rows: list[tuple]) -> pa.RecordBatch:
    """A block as one row: names and lengths, the bases at 2 bits with a gap after each sequence, and the stretches
    [begin, end) that are no bases."""
    code = _CODE[np.frombuffer(b"".join(s.encode("ascii", "replace") + b"-" for _, s in rows), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], code > 3, [False]]).astype(np.int8))).astype(np.int64)
    four = np.concatenate([code & 3, np.zeros(-len(code) % 4, np.uint8)]).reshape(-1, 4)
    bases = (four << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    cells = [[block], [[i for i, _ in rows]], [[len(s) for _, s in rows]], [bases.tobytes()], [edge.tobytes()]]
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], ["block", "names", "lens", "bases", "bad"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, seq_id, seq) in order of their block."""
    rows, at = [], None
    for b in batches:
        for block, name, seq in zip(*(b.column(i).to_pylist() for i in range(3))):
            if rows and block != at:
                yield _pack(at, rows)
                rows = []
            at = block
            rows.append((name, seq))
    if rows:
        yield _pack(at, rows)


def blocks(seqs: DataFrame, k: int) -> DataFrame:
    """The sequences (seq_id, seq) that have k-mers, in blocks of about BLOCK bases at 2 bits each, as a settled table.
    Those of one id share a block."""
    s = seqs.select(F.col("seq_id").cast("string").alias("seq_id"), F.upper("seq").alias("seq")).where(F.length("seq") >= k)
    n = -(-(s.agg(F.sum(F.length("seq").cast("bigint"))).first()[0] or 1) // BLOCK)
    s = s.select(F.pmod(F.xxhash64("seq_id"), F.lit(n)).alias("block"), "seq_id", "seq")
    return settle(s.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_packed, _BLOCK_SCHEMA))


class _Block:
    """A block in a task: `kmers` are its parts of w letters in order, each the lesser of itself and its reverse
    complement above its begin (31 bits) and whether it is the reverse complement (1 bit)."""

    def __init__(self, row: tuple, w: int):
        names, self.lens, bases, bad = row
        ids = {x: i for i, x in enumerate(dict.fromkeys(names))}
        self.names, self.ids = list(ids), np.array([ids[x] for x in names], np.int64)
        self.lens = np.array(self.lens, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lens + 1)])
        code = _BASES[np.frombuffer(bases, np.uint8)].ravel()[: self.starts[-1]]
        if len(code) >> 30:
            raise ValueError("a sequence is too long for one block")
        good = np.ones(max(0, len(code) - w + 1), bool)
        for beg, end in np.frombuffer(bad, np.int64).reshape(-1, 2).tolist():
            good[max(0, beg - w + 1) : end] = False
        self.kmers, n = np.empty(np.count_nonzero(good), np.uint64), 0
        for lo in range(0, len(good), STEP):
            ok = good[lo : lo + (STEP)]
            ahead, back = _codes(code[lo : lo + len(ok) + w - 1].astype(np.uint32), w)
            key = np.minimum(ahead, back).astype(np.uint64) << 32 | np.arange(lo, lo + len(ok), dtype=np.uint64) << 1 | (back < ahead)
            key = key[ok]
            self.kmers[n : n + len(key)] = key
            n += len(key)
        self.kmers.sort()
        #: Begins are counted step by step, unless several sequences that have one id share them.
        self.step = STEP if len(self.names) == len(self.lens) else 1 << 62
        self.near = np.searchsorted(self.starts, np.arange(0, len(code), 16), "right") - 1

    def seq_of(self, beg: np.ndarray) -> np.ndarray:
        """The sequences in which these places are, looked up from every 16th place."""
        at = self.near[beg >> 4]
        while (later := beg >= self.starts[at + 1]).any():
            at = at + later
        return at


def _codes(code: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """The w letters from each place as a number, and those of their reverse complement: put together from stretches
    of 1, 2, 4, ... letters."""
    size, ahead, back, done = 1, code, 3 - code, None
    while True:
        if w & size:
            if done is None:
                done = size, ahead, back
            else:
                n, x, y = done
                m = len(ahead) - n
                done = n + size, x[:m] << 2 * size | ahead[n:], back[n:] << 2 * n | y[:m]
        if size * 2 > w:
            return done[1:]
        m = len(ahead) - size
        ahead, back = ahead[:m] << 2 * size | ahead[size:], back[size:] << 2 * size | back[:m]
        size *= 2


def _hits(q: _Block, t: _Block, w: int) -> Iterator[tuple]:
    """(sides, begin in q, begin in t, minus) of equal parts on either strand, begins on the forward strand, about a
    step of them at once. All hits of a part come at once, for both sides; those of a part with more come side by
    side: for `q` with all hits of a begin in q at once, and again for `t` with all of a begin in t."""
    step, lo, low = max(q.step, t.step), 0, np.uint64(0xFFFFFFFF)
    while lo < len(q.kmers):
        first, last = q.kmers[lo] >> 32, q.kmers[min(lo + step, len(q.kmers)) - 1] >> 32
        hi = lo + int(np.searchsorted(q.kmers[lo:], last << 32 | low, "right"))
        mine, lo = q.kmers[lo:hi], hi
        theirs = t.kmers[np.searchsorted(t.kmers, first << 32) : np.searchsorted(t.kmers, last << 32 | low, "right")]
        other = theirs >> 32
        shift = max(0, int(last - first).bit_length() - 20)
        there = np.zeros((int(last - first) >> shift) + 1, bool)  # a quick look before the search
        there[other - first >> shift] = True
        mine = mine[there[(mine >> 32) - first >> shift]]
        code = mine >> 32
        beg = np.searchsorted(other, code)
        n = np.searchsorted(other, code, "right") - beg
        mine, code, beg, n = (x[n > 0] for x in (mine, code, beg, n))
        if not len(n):
            continue
        part = np.append(np.flatnonzero(_firsts(code)), len(n))
        upto, cut = np.concatenate([[0], np.cumsum(n)])[part], 0
        while cut < len(part) - 1:
            end = max(cut + 1, int(np.searchsorted(upto, upto[cut] + step, "right")) - 1)
            x, y = slice(part[cut], part[end]), slice(beg[part[cut]], beg[part[cut]] + n[part[cut]])
            if upto[end] - upto[cut] <= step:
                m = n[x]
                yield "qt", *_met(np.repeat(mine[x], m), theirs[np.repeat(beg[x] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))], w)
            else:  # one part
                a, b = mine[x], theirs[y]
                for i in range(0, len(a), few := max(1, step // len(b))):
                    yield "q", *_met(np.repeat(a[i : i + few], len(b)), np.tile(b, len(a[i : i + few])), w)
                for i in range(0, len(b), few := max(1, step // len(a))):
                    yield "t", *_met(np.tile(a, len(b[i : i + few])), np.repeat(b[i : i + few], len(a)), w)
            cut = end


def _met(a: np.ndarray, b: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p, r = (((x & 0xFFFFFFFF) >> 1).astype(np.int64) for x in (a, b))
    minus = ((a ^ b) & 1).astype(bool)
    if w % 2 == 0:  # a part that is its own reverse complement is on both strands
        both = _own_reverse(a >> 32, w)
        p, r, minus = np.append(p, p[both]), np.append(r, r[both]), np.append(minus, ~minus[both])
    return p, r, minus


def _own_reverse(code: np.ndarray, w: int) -> np.ndarray:
    back = np.zeros_like(code)
    for i in range(w):
        back |= (3 - (code >> 2 * i & 3)) << 2 * (w - 1 - i)
    return back == code


def _longer(q: _Block, hits: Iterator[tuple], k: int, w: int) -> Iterator[tuple]:
    """The same for whole k-mers, from the parts of w letters that cover them, in one step."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    p, r, minus = (np.concatenate(x) for x in zip(none, *(some for sides, *some in hits if "q" in sides)))
    p = np.where(minus, q.starts[-1] - w - p, p)  # along the strand
    top = int(max(p.max(initial=0), r.max(initial=0))) + k + 1
    known, keep = np.sort((r * top + p) * 2 + minus), np.ones(len(p), bool)
    for off in [*range(w, k - w, w), k - w]:
        want = ((r + off) * top + p + off) * 2 + minus
        keep &= np.append(known, -1)[np.searchsorted(known, want)] == want
    yield "qt", np.where(minus, q.starts[-1] - k - p, p)[keep], r[keep], minus[keep]


def _order(keys: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    """The order by the keys (the first weighs most), each below its size."""
    total = 1
    for s in sizes:
        total *= s
    if total >= 1 << 63:
        return np.lexsort(keys[::-1])
    key = np.zeros(len(keys[0]), np.int64)
    for x, s in zip(keys, sizes):
        key = key * s + x
    return np.argsort(key)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    return new


def _summed(at: np.ndarray, q0, q1, t0, t1, n) -> list[np.ndarray]:
    return [f.reduceat(x, at) for f, x in ((np.minimum, q0), (np.maximum, q1), (np.minimum, t0), (np.maximum, t1), (np.add, n))]


class _Found:
    """The bands of the hits of one block's sequences on another's."""

    def __init__(self, q: _Block, t: _Block, k: int, band: int):
        self.q, self.t, self.k, self.band = q, t, k, band
        self.low = -(int(q.lens.max()) // band) - 1
        self.span = int(t.lens.max()) // band + 2 - self.low
        self.kept: list[tuple] = []
        # sequences count as one where id and length are equal
        self.q_of, self.t_of = (np.unique(np.stack([x.ids, x.lens]), axis=1, return_inverse=True) for x in (q, t))

    def add(self, p: np.ndarray, r: np.ndarray, minus: np.ndarray) -> None:
        qs, ts = self.q.seq_of(p), self.t.seq_of(r)
        p, r = p - self.q.starts[qs], r - self.t.starts[ts]
        p = np.where(minus, self.q.lens[qs] - self.k - p, p)
        pair = (self.q_of[1].ravel()[qs] * self.t_of[0].shape[1] + self.t_of[1].ravel()[ts]) * 2 + minus
        d = (r - p) // self.band - self.low
        o = _order([pair, d, p], [self.q_of[0].shape[1] * self.t_of[0].shape[1] * 2, self.span, int(self.q.lens.max())])
        pair, d, p, r = pair[o], d[o], p[o], r[o]
        if len(o):
            at = np.flatnonzero(_firsts(pair, d))
            self.kept.append((pair[at], d[at], *_summed(at, p, p, r, r, _firsts(pair, d, p).astype(np.int64))))

    def rows(self, least: int) -> pa.RecordBatch | None:
        if not self.kept:
            return None
        pair, d, *rest = (np.concatenate(x) for x in zip(*self.kept))
        (q_id, q_len), (t_id, t_len), n_t = self.q_of[0], self.t_of[0], self.t_of[0].shape[1]
        named = (q_id[pair // 2 // n_t] * len(self.t.names) + t_id[pair // 2 % n_t]) * 2 + pair % 2
        o = _order([named, d, pair], [len(self.q.names) * len(self.t.names) * 2, self.span, len(q_id) * n_t * 2])
        named, d, pair, rest = named[o], d[o], pair[o], [x[o] for x in rest]
        at = np.flatnonzero(_firsts(named))
        enough = np.repeat(np.add.reduceat(rest[4], at) >= least, np.diff(np.append(at, len(o))))
        named, d, pair, rest = named[enough], d[enough], pair[enough], [x[enough] for x in rest]
        if not len(d):
            return None
        at = np.flatnonzero(_firsts(named, d, pair))
        named, d, pair, rest = named[at], d[at], pair[at], _summed(at, *rest)
        run = np.cumsum(_firsts(named) | (np.diff(d, prepend=d[0]) != 1))
        o = np.lexsort((run, pair))
        pair, run, rest = pair[o], run[o], [x[o] for x in rest]
        at = np.flatnonzero(_firsts(pair, run))
        pair, (q0, q1, t0, t1, n) = pair[at], _summed(at, *rest)
        ok = n >= least
        pair, q0, q1, t0, t1, n = pair[ok], q0[ok], q1[ok] + self.k, t0[ok], t1[ok] + self.k, n[ok]
        qs, ts, minus = pair // 2 // n_t, pair // 2 % n_t, pair % 2 == 1
        size = q_len[qs]
        name = lambda x, ids: pa.array([x.names[i] for i in ids.tolist()], pa.string())
        columns = [
            name(self.q, q_id[qs]), size, np.where(minus, size - q1, q0), np.where(minus, size - q0, q1), pa.array(np.where(minus, "-", "+").tolist(), pa.string()),
            name(self.t, t_id[ts]), t_len[ts], t0, t1, n, q1 - q0, np.zeros(len(n), np.int64),
        ]
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], [x.split()[0] for x in PAF_SCHEMA.split(", ")])


def _aligner(k: int, band: int, least: int, mutual: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    w = min(k, PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, q = None, None
        for b in batches:
            for i in range(b.num_rows):
                (qi, *left), (ti, *right) = ([c[i].as_py() for c in b.columns[j : j + 5]] for j in (0, 5))
                if at != qi:
                    q = None  # no more than two blocks at once
                    at, q = qi, _Block(left, w)
                yield from one(q, q if mutual and qi == ti else _Block(right, w))

    def one(q: _Block, t: _Block) -> Iterator[pa.RecordBatch]:
        found = {"q": _Found(q, t, k, band)} | ({"t": _Found(t, q, k, band)} if mutual and t is not q else {})
        for sides, p, r, minus in _hits(q, t, w) if k == w else _longer(q, _hits(q, t, w), k, w):
            for side in set(sides) & set(found):
                found[side].add(*((p, r) if side == "q" else (r, p)), minus)
        for f in found.values():
            if (rows := f.rows(least)) is not None:
                yield rows

    return run


def kmer_align(queries: DataFrame, targets: DataFrame, k: int = 11, band: int = 16, least: int = 3) -> DataFrame:
    """PAF rows from shared k-mers, on both strands: shared k-mers of a query and a target whose diagonals fall into
    one or two neighbouring bands form a hit if there are at least `least`; the hit spans them, and `matches` is the
    number of distinct query positions. K-mers with other letters than ACGT are left out.

    Blocks of sequences meet pair by pair in a Cartesian product, and a task sorts the k-mers of its blocks and finds
    the equal ones; only the sequences, at 2 bits a base, and the hits that stand are stored or moved, never k-mers.
    Where queries and targets are one DataFrame object, a pair of blocks meets once, for both directions.

    Null and empty sequences have no hits. Meant for seeds and tests, not in place of a real aligner.
    """
    mutual = targets is queries
    q = blocks(queries, k)
    t = q if mutual else blocks(targets, k)
    few = t.coalesce(max(8, t.count() // 4))  # a task keeps the sorted block of a query for some targets
    pairs = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns]).crossJoin(few.select(*[F.col(c).alias(f"t_{c}") for c in t.columns]))
    if mutual:  # one of (i, j) and (j, i), spread evenly
        pairs = pairs.where("q_block = t_block or (q_block < t_block) = ((q_block + t_block) % 2 = 0)")
    return pairs.mapInArrow(_aligner(k, band, least, mutual), PAF_SCHEMA)


def simple_repeats(masked: DataFrame, least: float) -> DataFrame:
    """(seq_id, pct, simple): share of low-complexity intervals (seq_id, beg, end; disjoint) in the sequence of
    seq_len, and whether it reaches `least` per cent."""
    g = masked.groupBy("seq_id").agg(F.sum(F.col("end") - F.col("beg")).alias("__n"), F.max("seq_len").alias("__len"))
    pct = F.coalesce(F.try_divide(F.col("__n") * F.lit(100.0), F.col("__len")), F.lit(0.0))
    return g.select("seq_id", pct.alias("pct"), (pct >= least).alias("simple"))
