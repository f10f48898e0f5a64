"""Sizes of texts in tokens of a public byte-level BPE."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter everywhere, never part of this package.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Whole(Exception):
    """This text has to be encoded as a whole."""


class Counter(dict):
    """Counts tokens exactly, remembering the count of each blank-separated part.

    The pattern never joins what lies on both sides of a single blank, so the parts'
    counts add up. Where blanks meet other white space the text is encoded whole.
    """

    def __init__(self, path: str = VOCABULARY, most: int = 400_000):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.most = most
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, part: str) -> int:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Whole
        n = len(self.encoding.encode_ordinary(" " + part))
        if len(part) < 40 and len(self) < self.most:
            self[part] = n
        return n

    def count(self, text: str | None) -> int | None:
        if not text:
            return None if text is None else 0
        head, blank, rest = text.partition(" ")
        if not blank:
            return len(self.encoding.encode_ordinary(text))
        if not head or head[-1].isspace():
            return len(self.encoding.encode_ordinary(text))
        try:
            return len(self.encoding.encode_ordinary(head)) + sum(map(self.__getitem__, rest.split(" ")))
        except _Whole:
            return len(self.encoding.encode_ordinary(text))


def sizes(docs: DataFrame, key: str, text: str = "text", path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, *keep, tokens`` of each row; a null text has null tokens, an empty one 0."""
    kinds = dict(docs.dtypes)
    names = [key, *keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            n = pa.array(list(map(counter.count, b.column(len(names)).to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], n], names=[*names, "tokens"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", tokens bigint"
    return docs.select(*names, F.col(text).alias("_text")).mapInArrow(work, schema)
