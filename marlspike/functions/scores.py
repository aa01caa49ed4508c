"""Scoring formulas of retrieval and fusion as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 30
LARGE_COLLECTION = 10_000


def rrf(rank: Column, k: Column | int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank if isinstance(k, int) else k + rank)


def scaled_rrf_k(size: Column, k: int = RRF_K) -> Column:
    """The fusion constant grows with the logarithm of a large collection, up to three times."""
    grown = F.floor(k * F.least(F.lit(1.0) + F.log10(size / LARGE_COLLECTION), F.lit(3.0)))
    return F.when(size < LARGE_COLLECTION, F.lit(k).cast("bigint")).otherwise(grown)


def adaptive_depth(base: int, size: Column, filtered: Column, cap: int = 400) -> Column:
    """Rows to fetch for each query of a collection of the given size."""
    ratio = size / LARGE_COLLECTION
    factor = F.when(ratio > 1, F.least(F.lit(1.0) + F.sqrt(F.greatest(ratio - 1, F.lit(0.0))), F.lit(8.0))).otherwise(1.0)
    return F.least(F.floor(base * factor * F.when(filtered, 0.7).otherwise(1.0)), F.lit(max(base, cap)).cast("bigint"))


def sparse_to_rrf(raw: Column, k: int = RRF_K, weight: float = 1.0, top: float = 15.0) -> Column:
    """A raw lexical score mapped onto the range that fused ranks take."""
    low, high = 1.0 / (k + 50), 1.0 / (k + 1)
    return weight * (low + F.least(raw, F.lit(top)) / top * (high - low))


def sigmoid_z(score: Column, mean: Column, deviation: Column) -> Column:
    """A z-score squeezed into 0 to 1; 0.5 where there is no spread."""
    return F.when(deviation > 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-0.5 * (score - mean) / deviation))).otherwise(0.5)


def lexical_fields(symbol: Column, path: Column, code: Column) -> list[Column]:
    """What ``lexical_score`` reads, lower-cased once: select it before a join, so it is not made anew for each token."""
    sym, where, text = (F.lower(F.coalesce(c, F.lit(""))) for c in (symbol, path, code))
    return [sym.alias("_symbol"), F.regexp_replace(where, r"[/\\]", "\n").alias("_segments"), F.regexp_extract(where, r"([^/\\]*)$", 1).alias("_last"), text.alias("_code")]


def lexical_score(tokens: Column) -> Column:
    """Hits of query tokens in ``lexical_fields``: 2.0 in the symbol, 0.8 in a path segment and 0.3 more in the last, 1.0 in the
    code, all of it."""

    def one(t: Column) -> Column:
        return (
            F.when(F.contains("_symbol", t), 2.0).otherwise(0.0) + F.when(F.contains("_segments", t), 0.8).otherwise(0.0)
            + F.when(F.contains("_last", t), 0.3).otherwise(0.0) + F.when(F.contains("_code", t), 1.0).otherwise(0.0)
        )

    return F.aggregate(tokens, F.lit(0.0), lambda s, t: s + one(t))
