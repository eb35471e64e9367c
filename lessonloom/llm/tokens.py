"""Sizes of texts in tokens of a public tokenizer; the vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary of byte pairs as ranks and its splitting pattern, as the tokenizer's publisher gives them.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The encoder of one vocabulary file, loaded once a worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens; 0 for null and empty texts. Special tokens in a text are ordinary text."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode_ordinary
        for s in batches:
            yield s.map(lambda x: len(encode(x)) if x else 0).astype("int32")

    return count(text)
