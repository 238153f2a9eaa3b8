"""Tokenizers as a parameter: a function from texts to the ends of their tokens, in code points.

Chunks, budgets and estimates take the same one, so what is counted is what is cut. The tokens of a text joined give it back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each text the ends of its tokens in rising order, the last one the text's length. Tokens that share a character end together.
Tokenizer = Callable[[list[str]], list[list[int]]]


def fixed(size: int) -> Tokenizer:
    """Tokens of `size` code points each, the last one shorter."""
    return lambda texts: [[*range(size, len(t), size), len(t)] if t else [] for t in texts]


@lru_cache(2)
def _loaded(path: str):
    from tokenizers import Tokenizer as Loaded

    return Loaded.from_file(path)


def vocabulary(path: str) -> Tokenizer:
    """The tokens of a vocabulary file that all executors can read; what lies between two tokens belongs to the second one."""

    def ends(texts: list[str]) -> list[list[int]]:
        out = []
        for text, found in zip(texts, _loaded(path).encode_batch(texts, add_special_tokens=False), strict=True):
            at, last = [], 0
            for _, end in found.offsets:
                last = max(last, end)
                at.append(last)
            if text and (not at or at[-1] < len(text)):
                at = [*at[:-1], len(text)] if at else [len(text)]
            out.append(at)
        return out

    return ends


def pieces(text: Column, tokenizer: Tokenizer) -> Column:
    """ARRAY<STRING>: the text's tokens (null: none), in Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        said = texts.fillna("").tolist()
        return pd.Series([[t[a:b] for a, b in zip([0, *e[:-1]], e)] for t, e in zip(said, tokenizer(said), strict=True)])

    return cut(text)


def counted(text: Column, tokenizer: Tokenizer) -> Column:
    """The number of tokens of a text (null: 0)."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(e) for e in tokenizer(texts.fillna("").tolist())])

    return count(text)
