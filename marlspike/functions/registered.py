"""Functions for SQL: an embedder, a scorer and a table function of token windows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from . import tokens

DIM = 256
_IDENT = re.compile(tokens.IDENT)


def hash_embedding(text: str | None, dim: int = DIM) -> list[float]:
    """Token counts folded into ``dim`` numbers by the first 32 bits of the md5, of length 1; zeros for a text without a token."""
    out = [0.0] * dim
    for t, n in Counter(w.lower() for w in _IDENT.findall(text or "")).items():
        out[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] += n
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


def register(spark: SparkSession) -> None:
    """Registers ``embed(text)``, ``rerank_score(query, text)`` and the table function ``token_windows(text, size, stride)``."""

    @pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        known: dict = {}
        return text.map(lambda t: known[t] if t in known else known.setdefault(t, hash_embedding(t)))

    @pandas_udf("double")
    def rerank_score(query: pd.Series, text: pd.Series) -> pd.Series:
        words = lambda t: {w.lower() for w in _IDENT.findall(t or "")} - set(tokens.STOP_WORDS)
        return pd.Series([len(words(q) & words(t)) / len(words(q)) if words(q) else 0.0 for q, t in zip(query, text, strict=True)])

    @udtf(returnType="no int, piece string")
    class TokenWindows:
        def eval(self, text: str, size: int, stride: int):
            spans = [m.span() for m in re.finditer(r"\S+", text or "")]
            for no, s in enumerate(range(0, len(spans), stride)):
                yield no, text[spans[s][0] : spans[min(s + size, len(spans)) - 1][1]]
                if s + size >= len(spans):
                    break

    spark.udf.register("embed", embed)
    spark.udf.register("rerank_score", rerank_score)
    spark.udtf.register("token_windows", TokenWindows)
