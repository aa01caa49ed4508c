"""Query expansion: synonyms, feedback terms and token likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens

#: Synonyms of code search words; a table of more can be passed in their place.
SYNONYMS = {"function": ("method", "def", "fn"), "method": ("function", "member"), "class": ("type", "struct"), "create": ("init", "construct", "build"), "module": ("package", "library"), "printed": ("shown", "logged"), "cutoff": ("threshold", "limit")}


def expand(queries: DataFrame, synonyms: DataFrame, limit: int = 12) -> DataFrame:
    """(query_id, text, tier): the query itself (0), then each version with a word replaced (1), distinct, at most ``limit``.

    ``synonyms`` (word, synonym) is a table of configuration; words are matched whole by an equi-join on tokens.
    """
    words = queries.select("query_id", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))).alias("word"))
    swapped = words.join(synonyms, "word").select("query_id", F.expr("regexp_replace(text, concat('(?i)\\\\b', word, '\\\\b'), synonym)").alias("text"), F.lit(1).alias("tier"))
    every = queries.select("query_id", "text", F.lit(0).alias("tier")).unionByName(swapped).groupBy("query_id", "text").agg(F.min("tier").alias("tier"))
    w = Window.partitionBy("query_id").orderBy("tier", "text")
    return every.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")


def feedback_terms(ranked: DataFrame, texts: DataFrame, top: int = 8, terms: int = 6) -> DataFrame:
    """(query_id, term, n): the most frequent tokens of a query's best results. ``texts`` has id and text."""
    best = ranked.where(F.col("rank") <= top).select("query_id", "id").join(texts, "id")
    counted = best.select("query_id", F.explode(tokens.ident_tokens(F.col("text"), True)).alias("term")).where(F.length("term") > 2).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "term")
    return counted.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= terms).drop("_rn")


def intent(text: Column) -> Column:
    """identifier, conceptual or mixed, by names and question words."""
    has_name = text.rlike(r"[a-z]_[a-z]|[a-z][A-Z]|\w\(")
    asks = F.lower(F.trim(text)).rlike(r"^(how|what|why|when|where|which|explain|describe)\b") | F.contains(text, F.lit("?"))
    return F.when(has_name & ~asks, "identifier").when(asks & ~has_name, "conceptual").otherwise("mixed")


def learned(pairs: DataFrame, most: int = 5) -> DataFrame:
    """(token, expansion, weight): what stands with a token, at most ``most``, weighed by its share of all that does."""
    n = pairs.where("token <> expansion").groupBy("token", "expansion").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("token").agg(F.sum("n").alias("_t"))
    w = Window.partitionBy("token").orderBy(F.desc("n"), "expansion")
    best = n.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most)
    return best.join(total, "token").select("token", "expansion", F.round(F.col("n") / F.col("_t"), 6).alias("weight"))


#: Weights of the versions of a query: itself, a phrase replaced, a word replaced, a term of its neighbours.
TIERS = {"original": 1.0, "phrase": 0.85, "word": 0.6, "neighbour": 0.4}


def weighted(original: DataFrame, phrases: DataFrame, words: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(query_id, text, weight): all versions of a query, each at the weight of its best tier. All inputs: query_id, text."""
    parts = [df.select("query_id", "text", F.lit(w).alias("weight")) for df, w in zip((original, phrases, words, neighbours), TIERS.values(), strict=True)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return every.groupBy("query_id", "text").agg(F.max("weight").alias("weight"))


def neighbour_terms(ranked: DataFrame, names: DataFrame, queries: DataFrame, top: int = 8, least: float = 0.3, most: int = 10) -> DataFrame:
    """(query_id, term): parts of the names of a query's nearest points of at least the given score, without its own words; short
    ones first. ``names``: id, text."""
    near = ranked.where((F.col("rank") <= top) & (F.col("score") >= least)).join(names, "id")
    own = queries.select("query_id", tokens.ident_tokens(F.col("text"), True).alias("_own"))
    terms = near.select("query_id", F.explode(F.array_distinct(tokens.ident_tokens(F.col("text"), True))).alias("term")).distinct().join(own, "query_id")
    kept = terms.where(~F.array_contains("_own", F.col("term")) & (F.length("term") > 2)).select("query_id", "term")
    w = Window.partitionBy("query_id").orderBy(F.length("term"), "term")
    return kept.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def implied_query(filters: dict[str, str]) -> str:
    """A query for filters alone: the words of the names that they give."""
    import re

    given = " ".join(str(filters[k]) for k in ("symbol", "under", "path_glob", "kind", "language") if filters.get(k))
    return " ".join(dict.fromkeys(t.lower() for t in re.findall(tokens.IDENT, given)))
