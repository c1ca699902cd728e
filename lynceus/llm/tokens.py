"""Token counts under a public tokenizer; its files stay where they are, their folder is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the published pattern that splits text before byte-pair merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def encoding(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    import tiktoken

    ranks = {}
    for line in (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines():
        token, rank = line.split()
        ranks[base64.b64decode(token)] = int(rank)
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> Column:
    """Tokens of a whole text; 0 for null and empty texts."""

    @F.pandas_udf(T.IntegerType())
    def count(s: pd.Series) -> pd.Series:
        e = encoding(folder, name)
        return s.map(lambda x: len(e.encode_ordinary(x)) if x else 0).astype("int32")

    return count(text)


def sized(documents: DataFrame, keep: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """The kept columns and n_tokens. The scan reads nothing else."""
    return documents.select(*keep, token_count(F.col("text"), folder).alias("n_tokens"))
