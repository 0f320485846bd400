"""Token counts by a public tokenizer, in Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary file with a split pattern beside it; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the split pattern published with this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

@functools.cache
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of one text; none for null."""
    if not text:
        return 0
    return len(_encoding(path).encode_ordinary(text))


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of ``text`` as int; 0 for null or empty.  Texts of any length are
    encoded whole, in time that grows with the length."""

    @F.pandas_udf("int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([count(t, path) for t in texts], dtype="int32")

    return counted(text)
