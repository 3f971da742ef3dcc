"""Interfaces of model calls (embedding, re-ranking, judging) with deterministic local stand-ins.

A scorer is a function from columns to a column; a remote model is wrapped as an
Arrow-batched pandas UDF with the same shape.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Scorer = Callable[..., Column]


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """Unit vector of hashed word counts: no model, equal for equal texts."""

    @F.pandas_udf("array<float>")
    def embed(batch: pd.Series) -> pd.Series:
        out = []
        for value in batch:
            v = np.zeros(dim, np.float32)
            for word in (value or "").lower().split():
                h = hash_word(word)
                v[h % dim] += 1 if h & (1 << 20) else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed(text)


def hash_word(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def lexical_rerank(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that the text has."""
    asked = F.array_distinct(F.split(F.lower(question), r"\W+"))
    return F.size(F.array_intersect(asked, F.split(F.lower(text), r"\W+"))) / F.greatest(F.size(asked), F.lit(1))


def fail_open(score: Column, default: float = 1.0) -> Column:
    """A judge's missing score counts as relevant."""
    return F.coalesce(score, F.lit(default))
