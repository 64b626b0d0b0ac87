"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import spread

#: Where the vocabulary's ranks lie on every machine; the file isn't part of this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The published pre-tokenization pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
#: Pieces up to this length are counted once per worker and remembered, at most so many of them.
REMEMBER_CHARS, REMEMBER = 48, 400_000


class TokenCounter(dict):
    """Exact token counts. No token of the pattern goes from a visible character into white space, so a text's count is
    the sum over its pieces of white space and what follows up to the next white space; most pieces repeat and are only counted once."""

    def __init__(self, vocabulary: str = VOCABULARY):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("emberline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pieces = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= REMEMBER_CHARS and len(self) < REMEMBER:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.pieces(text)))


_counters: dict[str, TokenCounter] = {}


def counter(vocabulary: str = VOCABULARY) -> TokenCounter:
    """The worker's own counter, made once."""
    if vocabulary not in _counters:
        _counters[vocabulary] = TokenCounter(vocabulary)
    return _counters[vocabulary]


def token_count(column: str = "text", vocabulary: str = VOCABULARY):
    """A column with the number of tokens of a text: 0 for null and empty ones; bytes that are no UTF-8 count as replacement characters."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        size = counter(vocabulary).count
        for texts in batches:
            yield pd.Series([0 if x is None else size(bytes(x).decode("utf-8", "replace")) for x in texts], dtype="int64")

    return count(F.col(column).cast("binary"))


def sized(documents: DataFrame, *columns: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id``, the given columns and ``tokens``; rows without id are left out."""
    named = spread(documents.filter(F.col("doc_id").isNotNull()), "doc_id")
    return named.select("doc_id", *columns, token_count("text", vocabulary).alias("tokens"))
