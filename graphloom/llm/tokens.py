"""Sizes of texts in tokens of a public tokenizer. The vocabulary file's place is a parameter; nothing is copied here."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import widen

VOCABULARY = os.environ.get("GRAPHLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The pattern that splits text into words before byte-pair merging; it belongs to the public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in parts that end at line ends, so a word never grows without bound.
PART = 1 << 16


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int | None:
    return None if text is None else len(_encoding(path).encode_ordinary(text))


def with_token_count(docs: DataFrame, text: str = "text", into: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with the number of tokens of the whole text; null for a null text."""

    @F.pandas_udf("long")
    def size(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: None if t is None else len(_encoding(vocabulary).encode_ordinary(t))).astype("Int64")

    return widen(docs).withColumn(into, size(F.col(text)))
