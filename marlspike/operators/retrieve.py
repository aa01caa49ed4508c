"""Dense and lexical retrieval, fusion and collection statistics."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, tokens
from ..session import cut_lineage, rounded, spread_rows

#: Query vectors, and query texts, that go to the executors at a time; more are taken block by block.
BROADCAST_QUERIES, SCAN_QUERIES = 20_000, 2_000
#: Terms up to which a set of wanted ones is broadcast (some 30 MB).
BROADCAST_TERMS = 1_000_000
_IDENT = re.compile(tokens.IDENT)


def top_k(df: DataFrame, group: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts each partition to k before the shuffle."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= k)


def query_blocks(queries: DataFrame, id_col: str, size: int) -> list[DataFrame]:
    """The rows of ``queries`` in blocks of about ``size`` by a hash of their id; one block if they fit."""
    n = -(-queries.count() // size)
    return [queries] if n <= 1 else [queries.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == i) for i in range(n)]


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BROADCAST_QUERIES) -> DataFrame:
    """(query_id, id, score, rank): exact cosine of a stated query set against all rows, the query itself left out.

    Queries go to the executors as matrices of about ``block_rows`` rows, one after the other; for each the corpus is scanned
    once in Arrow batches, multiplied, cut to k rows a query and batch, and only those are shuffled. All-zero vectors score
    0; null vectors and ids and vectors of another length than the queries' take no part.
    """
    kind = corpus.schema[id_col].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, score double"
    picked = queries.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    parts = [_dense_block(b.toPandas(), corpus, k, id_col, vec_col, schema) for b in query_blocks(picked, "id", block_rows)]
    found = [p for p in parts if p is not None]
    if not found:
        return corpus.sparkSession.createDataFrame([], f"{schema}, rank bigint")
    return top_k(reduce(DataFrame.unionByName, found), "query_id", [F.desc("score"), F.asc("id")], k)


def _dense_block(q: pd.DataFrame, corpus: DataFrame, k: int, id_col: str, vec_col: str, schema: str) -> DataFrame | None:
    """The best k of each Arrow batch of the corpus for each query of a block."""
    if not len(q):
        return None
    ids, dim = q["id"].to_numpy(), len(q["v"].iloc[0])

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    block = unit(np.stack(q["v"].to_numpy()).astype(np.float64)).T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            name = batch["id"].to_numpy()
            s = (unit(np.stack(batch["v"].to_numpy()).astype(np.float64)) @ block).round(6) + 0.0
            order = np.lexsort((np.broadcast_to(name, s.T.shape), -s.T), axis=1)[:, : k + 1]
            frame = pd.DataFrame({"query_id": np.repeat(ids, order.shape[1]), "id": name[order].reshape(-1), "score": np.take_along_axis(s.T, order, 1).reshape(-1)})
            yield frame[frame["query_id"] != frame["id"]]

    c = spread_rows(corpus.where(F.col(id_col).isNotNull() & (F.size(vec_col) == dim)).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")))
    return c.mapInPandas(run, schema)


class _Terms:
    """Term numbers of tokens: the first 32 bits of the md5, modulo ``dim`` if given; remembered up to a bound."""

    KEPT = 500_000

    def __init__(self, dim: int | None, drop_stop_words: bool) -> None:
        self.dim, self.stop, self.known = dim, frozenset(tokens.STOP_WORDS) if drop_stop_words else frozenset(), {}

    def counts(self, text: str | None) -> Counter:
        found: Counter = Counter()
        for t, n in Counter(w.lower() for w in _IDENT.findall(text or "")).items():
            if t in self.stop:
                continue
            if (term := self.known.get(t)) is None:
                term = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
                term = term % self.dim if self.dim else term
                if len(self.known) < self.KEPT:
                    self.known[t] = term
            found[term] += n
        return found


def lexical_scan(queries: DataFrame, corpus: DataFrame, k: int, dim: int | None = None, norm_queries: bool = False, norm_corpus: bool = False, drop_stop_words: bool = True, block_rows: int = SCAN_QUERIES) -> DataFrame:
    """(query_id, id, score, rank): the k texts of ``corpus`` (id, text) with the greatest dot product of term counts with each of
    ``queries`` (id, text), both sides scaled to length 1 where asked; texts without a common term are left out.

    Queries go to the executors in blocks as a sparse matrix; for each block the corpus is scanned once, every Arrow batch
    is cut to k rows a query, and only those are shuffled. Null texts have no term, rows with a null id take no part.
    """
    kind = corpus.schema["id"].dataType.simpleString()
    asked = queries.schema["id"].dataType.simpleString()
    schema = f"query_id {asked}, id {kind}, score double"
    picked = queries.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text")
    rows = spread_rows(corpus.where(F.col("id").isNotNull() & F.col("text").isNotNull()).select("id", "text"))
    found = []
    for block in query_blocks(picked, "id", block_rows):
        q = block.toPandas()
        vectors = [_Terms(dim, drop_stop_words).counts(t) for t in q["text"]]
        column = {term: i for i, term in enumerate(sorted({t for v in vectors for t in v}))}
        weights = np.zeros((len(column), len(q)))
        for i, v in enumerate(vectors):
            size = math.sqrt(sum(n * n for n in v.values())) if norm_queries else 1.0
            for term, n in v.items():
                weights[column[term], i] = n / size
        if column:
            found.append(rows.mapInPandas(_scorer(q["id"].to_numpy(), weights, column, k, dim, norm_corpus, drop_stop_words), schema))
    if not found:
        return corpus.sparkSession.createDataFrame([], f"{schema}, rank bigint")
    return top_k(reduce(DataFrame.unionByName, found), "query_id", [F.desc("score"), F.asc("id")], k)


def _scorer(names: np.ndarray, weights: np.ndarray, column: dict[int, int], k: int, dim: int | None, norm: bool, drop: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = _Terms(dim, drop)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                at, value, owner = [], [], []
                for i, text in enumerate(part["text"]):
                    found = terms.counts(text)
                    size = math.sqrt(sum(n * n for n in found.values())) if norm else 1.0
                    for term, n in found.items():
                        if (c := column.get(term)) is not None:
                            at.append(c)
                            value.append(n / size)
                            owner.append(i)
                if not at:
                    continue
                matrix = np.zeros((len(part), len(weights)))
                matrix[owner, at] = value
                s = (matrix @ weights).round(6)
                ids = part["id"].to_numpy()
                order = np.lexsort((np.broadcast_to(ids, s.T.shape), -s.T), axis=1)[:, :k]
                frame = pd.DataFrame({"query_id": np.repeat(names, order.shape[1]), "id": ids[order].reshape(-1), "score": np.take_along_axis(s.T, order, 1).reshape(-1)})
                yield frame[frame["score"] > 0]

    return run


def postings(docs: DataFrame, id_col: str, text_col: str, dim: int | None = None, drop_stop_words: bool = True) -> DataFrame:
    """(id, term, tf): hashed tokens and how often each occurs; with ``dim`` the hash is taken modulo it."""
    h = tokens.token_hash(F.col("_t"))
    toks = docs.select(F.col(id_col).alias("id"), F.explode(tokens.ident_tokens(F.col(text_col), drop_stop_words)).alias("_t"))
    return toks.groupBy("id", "_t").agg(F.count(F.lit(1)).alias("_n")).groupBy("id", (h % dim if dim else h).alias("term")).agg(F.sum("_n").alias("tf"))


def normalised(vectors: DataFrame) -> DataFrame:
    """Postings with L2-normalised weights."""
    norms = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("tf").cast("double") * F.col("tf"))).alias("_norm"))
    return vectors.join(norms, "id").select("id", "term", (F.col("tf") / F.col("_norm")).alias("w"))


def lexical_topk(queries: DataFrame, corpus: DataFrame, k: int, weight: str = "tf") -> DataFrame:
    """(query_id, id, score, rank): the dot product of two stored tables of postings by an equi-join on the term.

    For postings that exist already; texts are better scanned by ``lexical_scan``. A hot term is split by AQE's skew join.
    """
    q = queries.select(F.col("id").alias("query_id"), "term", F.col(weight).alias("_q"))
    hits = corpus.select("id", "term", F.col(weight).alias("_c")).join(q, "term")
    summed = hits.groupBy("query_id", "id").agg(F.sum(F.col("_q").cast("double") * F.col("_c")).alias("score"))
    return top_k(summed.withColumn("score", rounded("score")), "query_id", [F.desc("score"), F.asc("id")], k)


def fuse(lists: list[tuple[DataFrame, float]], k: int = scores.RRF_K, limit: int = 10) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked lists with columns query_id, id and rank."""
    parts = [df.select("query_id", "id", (w * scores.rrf(F.col("rank"), k)).alias("part")) for df, w in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    summed = every.groupBy("query_id", "id").agg(rounded(F.sum("part"), 9).alias("score"))
    return top_k(summed, "query_id", [F.desc("score"), F.asc("id")], limit)


def token_weights(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(term, df, weight): ln(1 + N / (df + 1)) over all documents, divided by its mean over the wanted terms."""
    n = docs.select(F.count(F.lit(1)).alias("n"))
    wanted = cut_lineage(wanted)
    small = wanted.count() <= BROADCAST_TERMS
    df = docs.select(F.col(id_col), F.explode(F.array_distinct(tokens.ident_tokens(F.col(text_col), True))).alias("term")).join(F.broadcast(wanted) if small else wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = wanted.join(df, "term", "left").join(F.broadcast(n)).select("term", F.coalesce("df", F.lit(0)).alias("df"), F.log(F.lit(1.0) + F.col("n") / (F.coalesce("df", F.lit(0)) + 1)).alias("idf"))
    mean = idf.agg(F.avg("idf").alias("mean"))
    return idf.join(F.broadcast(mean)).select("term", "df", rounded(F.col("idf") / F.col("mean")).alias("weight"))


def normalise_scores(ranked: DataFrame, group: str = "query_id", score: str = "score") -> DataFrame:
    """Scores as sigmoids of their z-scores within a group (population deviation)."""
    stats = ranked.groupBy(group).agg(F.avg(score).alias("_m"), F.stddev_pop(score).alias("_s"))
    return ranked.join(stats, group).withColumn("norm", rounded(scores.sigmoid_z(F.col(score), F.col("_m"), F.col("_s")))).drop("_m", "_s")


def projection(dim: int, out: int, seed: int = 1337) -> list[list[float]]:
    """``out`` rows of random signs over the root of ``out``: a projection that keeps distances about, the same in every session."""
    rng = random.Random(seed)
    size = 1 / math.sqrt(out)
    return [[size if rng.random() < 0.5 else -size for _ in range(dim)] for _ in range(out)]


def project(vector: Column, dim: int, out: int, seed: int = 1337) -> Column:
    """A vector's projection to ``out`` numbers, of length 1."""
    raw = F.array(*[tokens.dot(vector, F.array(*[F.lit(x) for x in row])) for row in projection(dim, out, seed)])
    return F.get(F.transform(F.array(raw), lambda r: F.transform(r, lambda x: F.when(tokens.dot(r, r) > 0, x / F.sqrt(tokens.dot(r, r))).otherwise(0.0))), F.lit(0))


def gated_topk(queries: DataFrame, corpus: DataFrame, dim: int, k: int, gate: int = 200, small: int = 16) -> DataFrame:
    """(query_id, id, score, rank): the best k by exact cosine among the ``gate`` best by small projected vectors (vec_id, embedding)."""
    mini = lambda df: df.select("vec_id", project(F.col("embedding"), dim, small).alias("embedding"))
    near = dense_topk(mini(queries), mini(corpus), gate).select("query_id", "id")
    a = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_a"))
    b = corpus.select(F.col("vec_id").alias("id"), F.col("embedding").alias("_b"))
    scored = near.join(a, "query_id").join(b, "id").select("query_id", "id", rounded(tokens.cosine(F.col("_a"), F.col("_b"))).alias("score"))
    return top_k(scored, "query_id", [F.desc("score"), F.asc("id")], k)


def best_of_variants(ranked: DataFrame, of: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the lists of a query's variants (``of``: variant_id, query_id) in one, each row at its best raw score."""
    met = ranked.withColumnRenamed("query_id", "variant_id").join(of, "variant_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return top_k(met, "query_id", [F.desc("score"), F.asc("id")], k)
