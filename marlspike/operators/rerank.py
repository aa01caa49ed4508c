"""Second-stage ranking: score blends, iterated scoring with early stops, mode order."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import rounded


def blend_scores(ranked: DataFrame, second: str = "second", first: str = "score", share: float = 0.6) -> DataFrame:
    """``final`` = share of the min-max scaled second score + the rest of the first over its maximum (1 at least)."""
    stats = ranked.groupBy("query_id").agg(F.min(second).alias("_lo"), F.max(second).alias("_hi"), F.max(first).alias("_top"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(second) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return ranked.join(stats, "query_id").withColumn("final", rounded(share * scaled + (1 - share) * F.col(first) / F.greatest(F.lit(1.0), F.col("_top")))).drop("_lo", "_hi", "_top")


def overlap_score(query: Column, text: Column) -> Column:
    """The share of a query's tokens that a text holds: the default model where no other is given."""
    return F.when(F.size(query) > 0, rounded(F.size(F.array_intersect(query, text)) / F.size(query))).otherwise(0.0)


def mode_order(ranked: DataFrame, is_core: Column, is_doc: Column, docs_first: bool = False) -> DataFrame:
    """Ranks anew: core files, others, documents; or the other way round."""
    group = F.when(is_core, 0).when(is_doc, 2).otherwise(1)
    w = Window.partitionBy("query_id").orderBy(F.desc(group) if docs_first else group, "rank")
    return ranked.withColumn("mode_rank", F.row_number().over(w).cast("bigint"))


def alpha(step: int, steps: int, high: float = 0.8, low: float = 0.2) -> float:
    """Cosine decay of the weight of new scores."""
    return low + 0.5 * (high - low) * (1 + math.cos(math.pi * step / max(1, steps - 1)))


def rerank_recursive(query: np.ndarray, documents: np.ndarray, initial: np.ndarray, steps: int = 3, seed: int = 11) -> np.ndarray:
    """Scores by a fixed small network over (query, document, state), the state drawn towards the documents that score high;
    it ends when the first five keep their order or scores move by less than 0.01 on average."""
    rng = np.random.default_rng(seed)
    d = documents.shape[1]
    w1, w2 = rng.normal(0, (2 / (3 * d)) ** 0.5, (3 * d, d)), rng.normal(0, (2 / d) ** 0.5, d)
    state, score = query.copy(), initial.astype(float)
    for t in range(steps):
        x = np.concatenate([np.broadcast_to(query, documents.shape), documents, np.broadcast_to(state, documents.shape)], 1)
        raw = np.maximum(x @ w1, 0) @ w2
        a = alpha(t, steps)
        new = a * (raw - raw.mean()) / (raw.std() + 1e-9) + (1 - a) * score
        share = np.exp(new - new.max())
        state = 0.5 * state + 0.5 * (share / share.sum()) @ documents
        settled = (np.argsort(-new)[:5] == np.argsort(-score)[:5]).all() or np.abs(new - score).mean() < 0.01
        score = new
        if settled and t:
            break
    z = lambda v: (v - v.mean()) / (v.std() + 1e-9)
    return 0.5 * z(score) + 0.5 * z(initial.astype(float))


def recursive(ranked: DataFrame) -> DataFrame:
    """``rerank_recursive`` for each query over rows of query_id, id, query_vec, vec and score; a query's rows are its top k."""
    def one(rows: pd.DataFrame) -> pd.DataFrame:
        score = rerank_recursive(np.asarray(rows["query_vec"].iloc[0], float), np.stack(rows["vec"].to_numpy()).astype(float), rows["score"].to_numpy())
        return pd.DataFrame({"query_id": rows["query_id"], "id": rows["id"], "final": score.round(6)})

    return ranked.groupBy("query_id").applyInPandas(one, "query_id bigint, id bigint, final double")


def vicreg(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(invariance, variance, covariance) parts of the loss of two views of a batch."""
    spread = lambda v: np.maximum(0, 1 - np.sqrt(v.var(0, ddof=1) + 1e-4)).mean()

    def off(v: np.ndarray) -> float:
        c = np.cov(v.T)
        return float((c**2).sum() - (np.diag(c) ** 2).sum()) / v.shape[1]

    return float(((x - y) ** 2).mean()), float(spread(x) + spread(y)), off(x) + off(y)
