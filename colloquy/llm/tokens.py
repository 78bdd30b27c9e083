"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where the vocabulary is read from; None: the installed vocabulary files.
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """Byte-level BPE over the ranks in the file ``vocabulary``: a path, or the name of an installed public file."""
    import public_tokenizers
    import tiktoken

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, vocabulary: str = DEFAULT_VOCABULARY) -> Column:
    """Tokens of the whole ``text`` as BIGINT; 0 for null and empty texts."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, "long")(text)
