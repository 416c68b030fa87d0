"""Token counts with a public tokenizer's vocabulary."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default vocabulary; the path is a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern that belongs to the vocabulary (a fixed value of it).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a rank file; loaded once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _found(path: str) -> str:
    from pyspark import SparkFiles

    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def token_count(text: str | Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of the whole text; 0 for null and empty texts.

    Marked as not deterministic, though it is, so that a filter on the count does not make Spark count twice. The rank
    file is read where the tasks run: at ``path`` on every worker, or by its name alone if it was shipped with the job
    (``SparkContext.addFile``).
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count.asNondeterministic()(text)
