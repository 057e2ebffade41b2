"""Token counts with a tokenizer of choice.

The default counts pre-tokens by a pattern (words, numbers, single signs): an approximation for where no vocabulary is
at hand. A vocabulary file of byte-level BPE ranks gives exact counts for that vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F

#: A public byte-level BPE vocabulary of 50,256 ranks, where it is installed.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PRE_TOKEN = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def pre_token_count(text: Column) -> Column:
    """Number of pre-tokens, inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(PRE_TOKEN)), F.lit(0))


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def bpe_count(path: str = VOCABULARY) -> Callable[[Column], Column]:
    """Counter of tokens by the ranks file at path; null text has none.

    Texts are encoded one at a time, so that a worker never holds the tokens of a whole batch.
    """

    @F.pandas_udf("int")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(path)
        for text in texts:
            yield pd.Series([len(encoder.encode_ordinary(x)) for x in text.fillna("")], dtype="int32")

    return count


def component_counts(system: Column, user: Column, assistant: Column, count: Callable[[Column], Column] = pre_token_count) -> Column:
    """Struct of system, user, assistant and total tokens, each part as what it adds to the text before it."""
    first, second, third = count(system), count(F.concat(system, user)), count(F.concat(system, user, assistant))
    return F.struct(first.alias("system"), (second - first).alias("user"), (third - second).alias("assistant"), third.alias("total"))
