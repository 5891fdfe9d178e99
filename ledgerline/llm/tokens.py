"""Token counts by a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The tokenizer's splitting pattern. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text, 0 for null and empty text; the vocabulary file must be on every executor."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(vocabulary)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)
