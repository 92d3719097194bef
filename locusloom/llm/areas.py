"""Subject areas of commit texts: one-versus-rest linear classifiers on hashed word n-grams.

Labels come from two sources: the given ones, and weak ones read off the address (file paths) and section metadata
(hunk headers, subject scopes) of every other document. Fitting sees a bounded sample of the rows so labelled: at most
LABELLED with given areas and about WEAK weakly labelled ones, spread evenly over the areas. Features are made where
the texts are; only hashes of sampled rows travel. The folds that calibrate the threshold of each area are fitted as
tasks beside the final model. Scoring covers every text, whole, in one pass without a shuffle; the weights it carries
have a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Bounds of the fitting sample, in labelled and weakly labelled rows. Everything else covers all rows.
LABELLED, WEAK = 8000, 2000
BITS = 18
FOLDS = 3
EPOCHS = 60
#: Strength of the prior on the weights, and the value of a pair of words against a word's.
PRIOR, PAIR = 0.3, 0.15
#: Deviation from chance, as a term of chi-square, from which a feature takes part.
TELLING = 3.0
#: A word of one area is hardly evidence against another, as texts may deal with two.
LEAST_WEIGHT = -0.02
#: Weight of a weakly labelled row, and the labels that make an area's own threshold count as much as the shared one.
WEAK_WEIGHT, FEW = 0.4, 60
#: Texts with a word, and the share of them with one area, from which that word in an address speaks for the area.
LEAST_TEXTS, PURITY = 2, 0.75
NONE = "none"

_WORD = re.compile(r"[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+")
_CONTEXT = re.compile(r"^ .*\n?", re.M)
_HUNK = re.compile(r"^@@[^@\n]*@@(.*)$", re.M)
_MARKS = re.compile(r"^(?:index [0-9a-f]|diff --git |Binary files |(?:new|deleted) file mode|similarity|rename |@@).*\n?", re.M)
#: The lines of a file up to its first hunk; only there do `--- ` and `+++ ` name files, in a hunk they are changed lines.
_FILE_HEAD = re.compile(r"^diff --git .*\n?(?:(?!@@|diff --git )(?:.+\n?|\n))*", re.M)
_FILE_NAMES = re.compile(r"^(?:--- |\+\+\+ ).*\n?", re.M)
_PATHS = re.compile(r"^diff --git a/(\S+)", re.M)
_HEADER = re.compile(
    r"^\s*(?:commit [0-9a-f]{7,}|From |From:|Author:|Date:|Commit:|changeset:|user:|date:|parent:|branch:|tag:|description:|r\d+ \||-{3,}|[A-Z][A-Za-z-]*-by:|Cc:|To:|Merge: ).*\n?",
    re.M,
)
_SUBJECT = re.compile(r"^Subject:(?: *\[[^\]]*\])?", re.M)
_SCOPE = re.compile(r"^\s*[a-z]+\(([^)\n]*)\):", re.M)


def sections(text: str) -> tuple[str, str, str, str]:
    """(message, paths, changed lines, section metadata) of a commit text; unchanged lines are left out."""
    text = text.replace("\r\n", "\n")
    if "Ã" in text:  # UTF-8 read as a single-byte encoding
        text = re.sub(r"[Â-ô][\x80-\xbf€-™]", _mend, text)
    cut = text.find("\ndiff --git ")
    head, body = (text, "") if cut < 0 else (text[: cut + 1], text[cut + 1 :])
    if cut < 0 and text.startswith("diff --git "):
        head, body = "", text
    message = _SUBJECT.sub("", _HEADER.sub("", head))
    meta = "\n".join(_HUNK.findall(body) + _SCOPE.findall(message))
    paths = "\n".join(_PATHS.findall(body))
    body = _FILE_HEAD.sub(lambda m: _FILE_NAMES.sub("", m[0]), body)
    changed = _CONTEXT.sub("", _MARKS.sub("", body))
    return message, paths, changed, meta


def _mend(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m[0]


def _stem(word: str) -> str:
    w = word.lower()
    return w[:-1] if len(w) > 3 and w.endswith("s") else w


class _Hashes(dict):
    """Written form -> hash of the word; a bounded memory of a process."""

    def __missing__(self, form: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        h = self[form] = zlib.crc32(_stem(form).encode())
        return h


_hashes = _Hashes()


def _hashed(forms: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, forms), dtype=np.uint64, count=len(forms))


def _word_ids(h: np.ndarray, bits: int) -> np.ndarray:
    return h * np.uint64(0xC2B2AE3D) >> np.uint64(7) & np.uint64((1 << bits) - 1)


def address_words(text: str, bits: int = BITS) -> np.ndarray:
    """Distinct hashed words, as in `word_features`, of the file paths and the section metadata."""
    _, paths, _, meta = sections(text)
    return np.unique(_word_ids(_hashed(_WORD.findall(paths + "\n" + meta)), bits)).astype(np.int64)


def word_features(text: str, bits: int = BITS) -> np.ndarray:
    """Distinct hashed words (below 2^bits) and pairs of words (from there on) of the message, paths and changed lines."""
    message, paths, changed, _ = sections(text)
    h = _hashed(_WORD.findall("\n".join((message, paths, changed))))
    if not len(h):
        return np.empty(0, dtype=np.int64)
    mixed = (h[:-1] * np.uint64(0x9E3779B1) ^ h[1:]) * np.uint64(0x85EBCA77)
    mask = np.uint64((1 << bits) - 1)
    one = _word_ids(h, bits)
    two = (mixed >> np.uint64(7) & mask) | np.uint64(1 << bits)
    return np.unique(np.concatenate([one, two])).astype(np.int64)


@dataclass
class AreaModel:
    """Linear one-versus-rest scores over hashed features, with a threshold per area and a most number of areas."""

    areas: list[str]
    weights: np.ndarray  # (2^(bits + 1), areas)
    bias: np.ndarray
    thresholds: np.ndarray
    most: int
    quality: dict[str, float]
    bits: int = BITS

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=0) + self.bias

    def pick(self, scores: np.ndarray) -> list[str]:
        over = np.flatnonzero(scores >= self.thresholds)
        best = over[np.argsort(-(scores - self.thresholds)[over], kind="stable")][: self.most]
        return [self.areas[i] for i in sorted(best)]


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ptr = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum([len(r) for r in rows], out=ptr[1:])
    return ptr, np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)


def _sums(w: np.ndarray, ptr: np.ndarray, idx: np.ndarray) -> np.ndarray:
    """Row sums of w over the index lists of a CSR layout."""
    out = np.zeros((len(ptr) - 1, w.shape[1]), dtype=w.dtype)
    full = np.flatnonzero(np.diff(ptr))
    if len(full):
        out[full] = np.add.reduceat(w[idx], ptr[:-1][full], axis=0)
    return out


def fit_linear(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, bits: int, epochs: int = EPOCHS, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Logistic one-versus-rest weights and biases by full-batch Adam, with a Gaussian prior on the weights; a
    feature of fewer than two rows, or one that tells no area apart, carries no weight, and a pair of words counts PAIR as much as a word."""
    size = 1 << (bits + 1)
    ptr, idx = _csr(rows)
    seen = np.bincount(idx, minlength=size)
    doc = np.repeat(np.arange(len(rows)), np.diff(ptr))
    share = y.mean(axis=0)
    tells = np.zeros(size)
    for j in range(y.shape[1]):
        n = np.bincount(idx, weights=y[doc, j], minlength=size)
        tells = np.maximum(tells, (n - seen * share[j]) ** 2 / (seen * share[j] + 1))
    kept = np.flatnonzero((seen >= 2) & (tells >= TELLING))  # the others are spread over the areas as if by chance
    to = np.full(size, -1, dtype=np.int64)
    to[kept] = np.arange(len(kept))
    scale = np.where(kept >> bits, PAIR, 1.0).astype(np.float32)[:, None]
    col = to[idx]
    doc, col = doc[col >= 0], col[col >= 0]
    ptr = np.searchsorted(doc, np.arange(len(rows) + 1))
    order = np.argsort(col, kind="stable")
    by_col = doc[order]
    cptr = np.searchsorted(col[order], np.arange(len(kept) + 1))
    k = y.shape[1]
    y, weight = y.astype(np.float32), weight.astype(np.float32)
    w, b = np.zeros((len(kept), k), dtype=np.float32), np.full(k, -2.0, dtype=np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    total = max(1.0, float(weight.sum()))
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(_sums(w * scale, ptr, col) + b, -30, 30)))
        g = (p - y) * weight[:, None] / total
        gw = _sums(g, cptr, by_col) * scale + np.float32(prior / total) * w
        gb = g.sum(axis=0)
        rate = np.float32(0.2 * (1 - t / (epochs + 1)) + 0.002)
        for x, gx, mx, vx in ((w, gw, m, v), (b, gb, mb, vb)):
            mx *= 0.9
            mx += 0.1 * gx
            vx *= 0.99
            vx += 0.01 * gx * gx
            x -= rate * (mx / (1 - 0.9**t)) / (np.sqrt(vx / (1 - 0.99**t)) + 1e-6)
        np.maximum(w, LEAST_WEIGHT, out=w)
    full = np.zeros((size, k), dtype=np.float32)
    full[kept] = w * scale
    return full, b


def _best_threshold(score: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """(threshold, F1) that is best on held-out scores, midway between neighbours; 0 where nothing is known."""
    if not truth.any():
        return 0.0, 0.0
    order = np.argsort(-score, kind="stable")
    s, t = score[order], truth[order]
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(t) + 1) + truth.sum())
    at = int(np.argmax(f1))
    low = s[at + 1] if at + 1 < len(s) else s[at] - 1.0
    return float((s[at] + low) / 2), float(f1[at])


def lexicon(rows: list[np.ndarray], y: np.ndarray, bits: int) -> np.ndarray:
    """For each hashed word the index of the area that it speaks for, or -1: it stands in LEAST_TEXTS of the area's
    texts, and PURITY of all texts that it stands in have the area."""
    ptr, idx = _csr(rows)
    doc = np.repeat(np.arange(len(rows)), np.diff(ptr))
    word = idx < (1 << bits)
    doc, idx = doc[word], idx[word]
    every = np.bincount(idx, minlength=1 << bits)
    out = np.full(1 << bits, -1, dtype=np.int8)
    for j in range(y.shape[1]):
        n = np.bincount(idx, weights=y[doc, j], minlength=1 << bits)
        out[(n >= LEAST_TEXTS) & (n >= PURITY * every)] = j
    return out


def weak_label(address: np.ndarray, speaks: np.ndarray) -> int:
    """The area that the address and section words of a text state; -1 where they state none or leave it open: two
    words of one area and none of others, or three and one of another."""
    said = speaks[address]
    count = np.bincount(said[said >= 0], minlength=1)
    top = int(count.argmax())
    rest = int(count.sum() - count[top])
    return top if count[top] >= 2 and rest == 0 or count[top] >= 3 and rest == 1 else -1


def _fit_part(part: int, known: list[np.ndarray], y: np.ndarray, others: list[np.ndarray], weak: np.ndarray, bits: int, epochs: int):
    """(weights, bias, rows held out) without fold `part` of the given labels; from all of them for part FOLDS."""
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in range(len(known))])
    out, rest = np.flatnonzero(fold == part), np.flatnonzero(fold != part)
    if not len(rest):
        return None
    rows = [known[i] for i in rest] + others
    w, b = fit_linear(rows, np.vstack([y[rest], weak]), np.r_[np.ones(len(rest)), np.full(len(others), WEAK_WEIGHT)], bits, epochs)
    return w, b, out


def _thresholds(held: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """(threshold per area, held-out F1 per area)."""
    shared, _ = _best_threshold(held.ravel(), y.ravel() > 0)
    chosen = [_best_threshold(held[:, j], y[:, j] > 0) for j in range(y.shape[1])]
    n = y.sum(axis=0)
    trust = n / (n + FEW)  # an area with few labels leans on the threshold of all
    return trust * np.array([c[0] for c in chosen]) + (1 - trust) * shared, [c[1] for c in chosen]


def _none_known(areas: list[str], most: int, bits: int) -> AreaModel:
    return AreaModel(areas, np.zeros((2 << bits, len(areas)), dtype=np.float32), np.zeros(len(areas)), np.full(len(areas), np.inf), most, {}, bits)


def fit_areas(labelled: list[tuple[str, set[str]]], others: list[str], areas: list[str], bits: int = BITS, epochs: int = EPOCHS, most: int = 2) -> AreaModel:
    """A model from texts with given areas (an empty set for none) and texts without, of which those take part whose
    addresses state an area. With nothing labelled, the model assigns no area."""
    y = np.array([[a in s for a in areas] for _, s in labelled], dtype=float).reshape(-1, len(areas))
    if not y.any():
        return _none_known(areas, most, bits)
    known = [word_features(t, bits) for t, _ in labelled]
    speaks = lexicon(known, y, bits)
    said = [(t, weak_label(address_words(t, bits), speaks)) for t in others]
    said = [(word_features(t, bits), j) for t, j in said if j >= 0]
    weak = np.eye(len(areas))[[j for _, j in said]].reshape(-1, len(areas))
    held = np.full_like(y, -9.0)
    for part in range(FOLDS + 1):
        got = _fit_part(part, known, y, [f for f, _ in said], weak, bits, epochs)
        if got is not None and part < FOLDS:
            held[got[2]] = _sums(got[0], *_csr([known[i] for i in got[2]])) + got[1]
    thresholds, quality = _thresholds(held, y)
    return AreaModel(areas, got[0], got[1], thresholds, most, dict(zip(areas, quality)), bits)


def _in_arrow(df: DataFrame, schema: str, make) -> DataFrame:
    """mapInArrow of a function (list of column lists) -> list of column lists."""
    names = [p.strip().split(" ")[0] for p in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = make(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=_ARROW[p.strip().split(" ")[1]]) for c, p in zip(got, schema.split(","))], names=names)

    return df.mapInArrow(run, schema)


_ARROW = {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64()}


def _bytes(ids: np.ndarray) -> bytes:
    return ids.astype(np.uint32).tobytes()


def _ids(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=np.uint32).astype(np.int64)


def _features(docs: DataFrame, bits: int) -> DataFrame:
    """(y, features) of (y, __text)."""
    return _in_arrow(docs.select("y", "__text"), "y int, features binary", lambda y, text: (y, [_bytes(word_features(t, bits)) for t in text]))


def _weak_rows(base: DataFrame, sampled: DataFrame, speaks: np.ndarray, n_areas: int, bits: int, weak_rows: int) -> DataFrame:
    """(y, features) of about weak_rows / n_areas documents of each area that addresses state. Every document outside
    the given labels is looked at; of those that state an area the least hashes are taken."""
    shared = base.sparkSession.sparkContext.broadcast(speaks)

    def label(at, text):
        words = shared.value
        said = [weak_label(address_words(t, bits), words) for t in text]
        return [h for h, j in zip(at, said) if j >= 0], [j for j in said if j >= 0]

    free = base.join(F.broadcast(sampled.select("__id")), "__id", "left_anti")
    hashed = F.pmod(F.xxhash64("__id"), F.lit(1 << 40))
    stated = settle(_in_arrow(free.select(hashed.alias("h"), "__text"), "h bigint, y int", label))
    counts = {r[0]: r[1] for r in stated.groupBy("y").count().collect()}  # one row per area at most
    share = F.create_map(*[F.lit(x) for j in range(n_areas) for x in (j, int((1 << 40) * min(1.0, weak_rows / n_areas / max(1, counts.get(j, 0)))))])
    # hashes are of 40 bits, so two documents hardly share one; if they do, both are taken, with the area of either
    chosen = stated.where(F.col("h") < share[F.col("y")]).groupBy("h").agg(F.min("y").alias("y"))
    return _features(base.withColumn("__h", hashed).join(F.broadcast(chosen), F.col("__h") == F.col("h")).select("y", "__text"), bits)


def area_model(docs: DataFrame, labels: DataFrame, areas: list[str], id_col: str = "doc_id", text_col: str = "text", label_rows: int = LABELLED, weak_rows: int = WEAK, bits: int = BITS, epochs: int = EPOCHS, most: int = 2) -> AreaModel:
    """Fits on the `label_rows` labelled rows of least hash of their id and on about `weak_rows` of the other rows whose
    addresses state an area (ids and texts that are null do not take part). Labels compare without case and
    surrounding white space; names that are no area count as none."""
    name = F.lower(F.regexp_replace("area", r"^\s+|\s+$", ""))
    mask = F.coalesce(*[F.when(name == a, F.lit(1 << j)) for j, a in enumerate(areas)], F.lit(0))
    given = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.bit_or(mask).alias("y"))
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    # the least hashes are found on the labels alone, then the texts of those few are read
    sampled = settle(given.orderBy(F.xxhash64("__id"), "__id").limit(label_rows))
    labelled = sorted((r["features"], r["y"]) for r in _features(base.join(F.broadcast(sampled), "__id"), bits).collect())
    y = np.array([[m >> j & 1 for j in range(len(areas))] for _, m in labelled], dtype=float).reshape(-1, len(areas))
    if not y.any():
        return _none_known(areas, most, bits)
    known = [_ids(f) for f, _ in labelled]
    stated = sorted((r["features"], r["y"]) for r in _weak_rows(base, sampled, lexicon(known, y, bits), len(areas), bits, weak_rows).collect())
    weak = np.eye(len(areas))[[j for _, j in stated]].reshape(-1, len(areas))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(([f for f, _ in labelled], y, [f for f, _ in stated], weak))

    def fit(parts):
        """Of a fold the scores of its rows, of the last part the weights, as (part, rows, values)."""
        raw, truth, more, said = shared.value
        rows, others = [_ids(f) for f in raw], [_ids(f) for f in more]
        out = []
        for part in parts:
            got = _fit_part(part, rows, truth, others, said, bits, epochs)
            if got is None:
                continue
            w, b, held = got
            if part < FOLDS:
                out.append((part, _bytes(held), (_sums(w, *_csr([rows[i] for i in held])) + b).astype(np.float64).tobytes()))
            else:
                kept = np.flatnonzero(w.any(axis=1))
                out.append((part, _bytes(kept), np.vstack([b[None, :], w[kept]]).astype(np.float64).tobytes()))
        return tuple([r[i] for r in out] for i in range(3))

    parts = spark.range(0, FOLDS + 1, 1, FOLDS + 1).select(F.col("id").cast("int").alias("part"))
    held, weights, bias = np.full_like(y, -9.0), np.zeros((2 << bits, len(areas)), dtype=np.float32), np.zeros(len(areas))
    for r in _in_arrow(parts, "part int, at binary, v binary", fit).collect():  # FOLDS + 1 rows
        v = np.frombuffer(r["v"]).reshape(-1, len(areas))
        if r["part"] < FOLDS:
            held[_ids(r["at"])] = v
        else:
            bias, weights[_ids(r["at"])] = v[0], v[1:]
    thresholds, quality = _thresholds(held, y)
    return AreaModel(areas, weights, bias, thresholds, most, dict(zip(areas, quality)), bits)


def assign_areas(docs: DataFrame, model: AreaModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, area, score) for each area of each text, none, one or `model.most` of them.

    Null and empty texts have no area; null ids are kept; repeated rows repeat their result; other columns are not
    read. Empty input, empty result.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = rows.select(id_col).withColumn("area", F.lit("")).withColumn("score", F.lit(0.0)).schema
    kept = np.flatnonzero(model.weights.any(axis=1))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.shape, kept, model.weights[kept], model.bias, model.thresholds))
    areas, most, bits = model.areas, model.most, model.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, at, some, b, t = shared.value
        w = np.zeros(shape, dtype=np.float32)
        w[at] = some
        m = AreaModel(areas, w, b, t, most, {}, bits)
        for batch in batches:
            at, named, scored = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                f = word_features(text, bits) if text else ()
                if len(f):
                    s = m.scores(f)
                    for a in m.pick(s):
                        at.append(i)
                        named.append(a)
                        scored.append(float(s[areas.index(a)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, type=pa.int64())), pa.array(named, type=pa.string()), pa.array(scored, type=pa.float64())], names=[id_col, "area", "score"])

    return rows.mapInArrow(run, schema)
