"""Token counts of texts under a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files and the file used; both are parameters of every operator that counts tokens.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pre-tokenization pattern that belongs to this vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for text that is all ASCII.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Words whose counts a worker remembers, and the longest of them. Beyond that it starts afresh.
REMEMBERED, LONGEST = 1 << 18, 64

_counters: dict[str, Callable[[str], int]] = {}


class _Counts(dict):
    """Word -> tokens; BPE never merges across words, so a text's count is the sum over its words."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


def read_vocabulary(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> bytes:
    with open(os.path.join(folder, vocabulary), "rb") as f:
        return f.read()


def token_counter(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, content: bytes | None = None) -> Callable[[str], int]:
    """A function text -> number of tokens, one per process and vocabulary, from the file's content where given."""
    path = os.path.join(folder, vocabulary)
    if path not in _counters:
        import tiktoken

        lines = (read_vocabulary(folder, vocabulary) if content is None else content).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}
        encode = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        known = _Counts(encode)

        def count(text: str) -> int:
            if text.isascii():
                return sum(map(known.__getitem__, ASCII.findall(text)))
            return len(encode(text))

        _counters[path] = count
    return _counters[path]


def count_tokens(df: DataFrame, text_col: str, keep: list[str], out: str = "tokens", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and the number of tokens of each whole text; 0 for null and empty texts.

    The driver reads the vocabulary and sends it along, so only it needs the file. Every row gives one row, repeated
    or not. Other columns are not read. Empty input, empty result.
    """
    content = df.sparkSession.sparkContext.broadcast(read_vocabulary(folder, vocabulary))
    rows = df.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    schema = rows.drop("__text").withColumn(out, F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(folder, vocabulary, content.value)
        for b in batches:
            n = b.num_columns - 1
            counts = pa.array([count(t) if t else 0 for t in b.column(n).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], counts], names=[*b.schema.names[:n], out])

    return rows.mapInArrow(run, schema)
