"""Structural code patterns: sketches of n-gram maps, hyperplane buckets, mining and likeness."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..session import rounded

#: The kinds of statements that a text without a syntax tree is counted by.
STATEMENTS = {"loop": r"\b(?:for|while|loop)\b", "branch": r"\b(?:if|else|elif|switch|match|case)\b", "try": r"\b(?:try|catch|except|finally)\b", "return": r"\breturn\b", "call": r"\w\("}


def statement_counts(text: Column) -> list[Column]:
    return [F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)).cast("bigint").alias(f"n_{k}") for k, p in STATEMENTS.items()]


def minhash(features: DataFrame, k: int = 16) -> DataFrame:
    """(id, seed, value): the least of each seeded hash over a set of features (id, feature)."""
    seeds = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("seed")
    hashed = features.select("id", tokens.token_hash(F.col("feature")).alias("_h")).distinct().select("id", "_h", seeds)
    return hashed.groupBy("id", "seed").agg(F.min((F.col("_h") * (2 * F.col("seed") + 1) + F.col("seed") * 7919) % (2**31)).alias("value"))


def simhash32(features: DataFrame) -> DataFrame:
    """(id, simhash): 32 bits, each the sign of the sum of the features' weights with and without that bit."""
    bits = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("_b")
    hashed = features.select("id", "weight", tokens.token_hash(F.col("feature")).alias("_h")).select("id", "weight", "_h", bits)
    signed = F.when(F.expr("shiftright(_h, _b) & 1") == 1, F.col("weight")).otherwise(-F.col("weight"))
    summed = hashed.groupBy("id", "_b").agg(F.sum(signed).alias("_s"))
    return summed.groupBy("id").agg(F.sum(F.when(F.col("_s") > 0, F.expr("shiftleft(1L, _b)")).otherwise(0)).cast("bigint").alias("simhash"))


def planes(tables: int, bits: int, dim: int) -> np.ndarray:
    """Hyperplanes seeded by a name, so that every session draws the same."""
    seed = int(hashlib.md5(f"planes-{tables}-{bits}-{dim}".encode()).hexdigest()[:8], 16)
    return np.random.default_rng(seed).normal(size=(tables, bits, dim)).round(4)


def hyperplane_buckets(vectors: DataFrame, dim: int, tables: int = 4, bits: int = 8) -> DataFrame:
    """(id, table, bucket) of vectors (id, vec) by the signs of their products with random planes."""
    out = []
    for t, table in enumerate(planes(tables, bits, dim)):
        bucket: Column = F.lit(0)
        for b, plane in enumerate(table):
            bucket = bucket + F.when(tokens.dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in plane])) > 0, 1 << b).otherwise(0)
        out.append(F.struct(F.lit(t).alias("table"), bucket.alias("bucket")))
    return vectors.select("id", F.explode(F.array(*out)).alias("_x")).select("id", "_x.table", "_x.bucket")


def common_features(features: DataFrame, groups: DataFrame, least: int = 3) -> DataFrame:
    """(group, members, common, weight): features that all members of a group of enough members have, by their least weight."""
    sized = groups.groupBy("group").agg(F.count_distinct("id").alias("members")).where(F.col("members") >= least)
    met = features.join(groups, "id").groupBy("group", "feature").agg(F.count_distinct("id").alias("_n"), F.min("weight").alias("_w"))
    shared = met.join(sized, "group").where("_n = members").groupBy("group").agg(F.count(F.lit(1)).alias("common"), F.sum("_w").cast("bigint").alias("weight"))
    return sized.join(shared, "group", "left").select("group", "members", F.coalesce("common", F.lit(0)).cast("bigint").alias("common"), F.coalesce("weight", F.lit(0)).cast("bigint").alias("weight"))


def flow_likeness(a: Column, b: Column, missing: float = 0.4) -> Column:
    """Overlap of two control-flow sequences; a fixed value where one is missing."""
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), missing).otherwise(rounded(tokens.jaccard(F.array_distinct(F.split(a, r"\|")), F.array_distinct(F.split(b, r"\|")))))


def simhash64(features: DataFrame) -> DataFrame:
    """(id, simhash): 64 bits of the features' md5, each the sign of the sum of weights with and without that bit."""
    half = lambda at: F.conv(F.substring(F.md5("feature"), at, 8), 16, 10).cast("bigint")
    signed = [F.sum(F.when(F.shiftright(c, b).bitwiseAND(F.lit(1)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{i}") for i, (c, b) in enumerate([(F.col("_hi"), b) for b in range(31, -1, -1)] + [(F.col("_lo"), b) for b in range(31, -1, -1)])]
    summed = features.select("id", "weight", half(1).alias("_hi"), half(9).alias("_lo")).groupBy("id").agg(*signed)
    bits = F.concat(*[F.when(F.col(f"b{i}") > 0, "1").otherwise("0") for i in range(64)])
    return summed.select("id", F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0")).alias("simhash"))


def similar_to(vectors: DataFrame, queries: DataFrame, dim: int, k: int = 10, tables: int = 10, bits: int = 8) -> DataFrame:
    """(query_id, id, score, rank): the best k by exact cosine among those that share a hyperplane bucket with a query."""
    from .retrieve import top_k

    buckets = hyperplane_buckets(vectors, dim, tables, bits)
    wanted = buckets.join(queries.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), "table", "bucket")
    pairs = buckets.join(wanted, ["table", "bucket"]).where("id <> query_id").select("query_id", "id").distinct()
    a, b = vectors.select(F.col("id").alias("query_id"), F.col("vec").alias("_a")), vectors.select("id", F.col("vec").alias("_b"))
    scored = pairs.join(a, "query_id").join(b, "id").select("query_id", "id", rounded(tokens.cosine(F.col("_a"), F.col("_b"))).alias("score"))
    return top_k(scored, "query_id", [F.desc("score"), F.asc("id")], k)


def prune_overlap(candidates: DataFrame, share: float = 0.6) -> DataFrame:
    """``candidates`` (query_id, id, score, query_features, features) with ``overlap``, the share of the query's features held, and
    ``final``, ``share`` of it and the rest of the score."""
    held = F.size(F.array_intersect("query_features", "features"))
    overlap = F.when(F.size("query_features") > 0, held / F.size("query_features")).otherwise(0.0)
    return candidates.withColumn("overlap", rounded(overlap)).withColumn("final", rounded(share * F.col("overlap") + (1 - share) * F.col("score")))
