"""Hybrid search over code chunks, for all queries in one job: a lexical and a dense list, fused with weights by the query's
intent, additive boosts and penalties, and the order-dependent end.

The dense list compares hash embeddings: token counts folded into DENSE_DIM numbers and scaled to length 1. A model's
vectors can take their place by ``dense``, a ranked list of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import queries as rules
from ..functions import scores, tokens
from ..operators import expand, filters, postprocess, retrieve
from ..session import cut_lineage, rounded

CANDIDATES, DENSE_DIM = 100, 256
DENSE_WEIGHT, LEXICAL_WEIGHT, TEXT_WEIGHT = 1.5, 1.0, 0.01
#: Factors of the dense and the lexical weight by the query's intent.
INTENT_WEIGHTS = {"conceptual": (1.25, 0.8), "identifier": (0.8, 1.25), "mixed": (1.0, 1.0)}
CORE, VENDOR, TEST, CONFIG, IMPLEMENTATION, DOCUMENT, RECENCY = 0.1, 0.05, 0.35, 0.3, 0.3, 0.25, 0.1
SYMBOL_PART, SYMBOL_EQUAL, FILENAME = 0.15, 0.25, 0.1
KEYWORD, KEYWORD_CAP, KEYWORD_ROWS = 0.3, 0.6, 200
PARTS = ["dense", "lexical", "text_score", "symbol_boost", "filename_boost", "path_adjust", "comment", "recency", "keyword"]

#: A line that declares something; the first group is its name.
DECLARATION = (
    r"^[ \t]*(?:(?:export|default|pub|public|private|protected|static|async|abstract|final)[ \t]+)*"
    r"(?:def|class|func|function|fn|interface|struct|trait|enum|type|impl)[ \t]+(\w+)"
)


def declared_symbol(code: Column) -> Column:
    """The first name that a chunk declares; empty without one."""
    return F.regexp_extract(F.coalesce(code, F.lit("")), "(?md)" + DECLARATION, 1)


def path_adjustment(path: Column) -> Column:
    """What a path adds to or takes from a score."""
    zero = F.lit(0.0)
    return (
        F.when(filters.is_core(path), CORE).otherwise(zero)
        - F.when(filters.is_vendor(path), VENDOR).otherwise(zero)
        - F.when(filters.is_test(path), TEST).otherwise(zero)
        - F.when(filters.is_config(path), CONFIG).otherwise(zero)
        + F.when(filters.extension(path).isin(*filters.CODE_EXTENSIONS), IMPLEMENTATION).otherwise(zero)
        - F.when(filters.is_document(path), DOCUMENT).otherwise(zero)
    )


def symbol_boost(query_tokens: Column, symbol: Column) -> Column:
    """The greatest boost of any query token: equal to the symbol, or part of it."""
    equal = F.exists(query_tokens, lambda t: t == symbol)
    part = F.exists(query_tokens, lambda t: F.contains(symbol, t))
    return F.when(symbol == "", 0.0).when(equal, SYMBOL_EQUAL).when(part, SYMBOL_PART).otherwise(0.0)


def filename_boost(query_tokens: Column, name_tokens: Column) -> Column:
    """FILENAME for each query token among those of the file's name, if there are at least two."""
    n = F.size(F.array_intersect(query_tokens, name_tokens))
    return F.when(n >= 2, n * FILENAME).otherwise(0.0)


def _texts(queries: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    return queries.select(F.col("query_id").alias("id"), "text"), points.select("id", F.concat_ws(" ", "path", "code").alias("text"))


def candidate_lists(queries: DataFrame, points: DataFrame, k: int = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(lexical, dense): the k best points of each query by sparse dot product, and by cosine of hash embeddings."""
    q, c = _texts(queries, points)
    lexical = retrieve.lexical_scan(q, c, k, norm_corpus=True)
    dense = retrieve.lexical_scan(q, c, k, dim=DENSE_DIM, norm_queries=True, norm_corpus=True, drop_stop_words=False)
    return lexical, dense


def fused(queries: DataFrame, lexical: DataFrame, dense: DataFrame) -> DataFrame:
    """(query_id, id, dense, lexical): reciprocal ranks of both lists, weighted by the query's intent."""
    kind = expand.intent(F.col("text"))
    factor = lambda i: F.when(kind == "conceptual", INTENT_WEIGHTS["conceptual"][i]).when(kind == "identifier", INTENT_WEIGHTS["identifier"][i]).otherwise(1.0)
    weights = queries.select("query_id", (DENSE_WEIGHT * factor(0)).alias("_wd"), (LEXICAL_WEIGHT * factor(1)).alias("_wl"))
    a = dense.select("query_id", "id", scores.rrf(F.col("rank")).alias("d"), F.lit(0.0).alias("l"))
    b = lexical.select("query_id", "id", F.lit(0.0).alias("d"), scores.rrf(F.col("rank")).alias("l"))
    met = a.unionByName(b).groupBy("query_id", "id").agg(F.sum("d").alias("d"), F.sum("l").alias("l"))
    return met.join(weights, "query_id").select("query_id", "id", rounded(F.col("d") * F.col("_wd"), 9).alias("dense"), rounded(F.col("l") * F.col("_wl"), 9).alias("lexical"))


def scored(queries: DataFrame, points: DataFrame, k: int = CANDIDATES, dense: DataFrame | None = None) -> DataFrame:
    """Candidates with every part of their score, ranked by score, then shorter symbol, path and line."""
    lexical, hashed = candidate_lists(queries, points, k)
    found = cut_lineage(fused(queries, lexical, hashed if dense is None else dense))
    toks = queries.select("query_id", tokens.query_tokens(F.array("text")).alias("tokens"))
    fields = points.select(
        "id", "path", "symbol", "start_line", "end_line", "modified", rounded(path_adjustment(F.col("path"))).alias("path_adjust"),
        (-rules.comment_penalty(rules.comment_share(F.col("code"))) + 0.0).alias("comment"), *scores.lexical_fields(F.col("symbol"), F.col("path"), F.col("code")),
    )
    # a point meets all its queries at once, so its text is not repeated for each; the list is bounded by the number of queries
    asked = found.join(toks, "query_id").groupBy("id").agg(F.collect_list(F.struct("query_id", "dense", "lexical", "tokens")).alias("_asked"))

    def for_query(x: Column) -> Column:
        t = x["tokens"]
        return F.struct(
            x["query_id"].alias("query_id"), x["dense"].alias("dense"), x["lexical"].alias("lexical"),
            rounded(TEXT_WEIGHT * scores.lexical_score(t)).alias("text_score"),
            symbol_boost(t, F.col("_symbol")).alias("symbol_boost"), rounded(filename_boost(t, F.col("_filename"))).alias("filename_boost"),
            F.size(F.filter(t, lambda w: F.contains("_code", w))).alias("_hits"),
        )

    # a stated number, so that the few bytes of a small table still go to all cores
    spark = points.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = fields.withColumn("_filename", tokens.filename_tokens(F.col("path")))
    met = named.repartition(tasks, "id").join(asked.repartition(tasks, "id"), "id")
    whole = ["id", "path", "symbol", "start_line", "end_line", "modified", "path_adjust", "comment"]
    parts = cut_lineage(met.select(*whole, F.explode(F.transform("_asked", for_query)).alias("_x")).select(*whole, "_x.*"))
    span = parts.groupBy("query_id").agg(F.min("modified").alias("_lo"), F.max("modified").alias("_hi"))
    age = (F.col("modified") - F.col("_lo")) / F.greatest(F.lit(1), F.col("_hi") - F.col("_lo"))
    recent = parts.join(span, "query_id").withColumn("recency", rounded(F.coalesce(RECENCY * age, F.lit(0.0))))
    first = sum((F.col(c) for c in PARTS[:-1]), F.lit(0.0))
    order = lambda s: [F.desc(s), F.length(F.coalesce("symbol", F.lit(""))), F.col("path"), F.col("start_line"), F.col("id")]
    by_query = Window.partitionBy("query_id")
    placed = recent.withColumn("_s", rounded(first)).withColumn("_r", F.row_number().over(by_query.orderBy(*order("_s"))))
    bump = F.when(F.col("_r") <= KEYWORD_ROWS, rounded(F.least(F.lit(KEYWORD_CAP), KEYWORD * F.col("_hits")))).otherwise(0.0)
    whole = placed.withColumn("keyword", bump).withColumn("score", rounded(F.col("_s") + F.col("keyword")))
    ranked = whole.withColumn("rank", F.row_number().over(by_query.orderBy(*order("score"))).cast("bigint"))
    return ranked.select("query_id", "rank", "id", "path", "symbol", "start_line", "end_line", *PARTS, "score")


def search(queries: DataFrame, points: DataFrame, limit: int = 10, per_path: int = 1) -> DataFrame:
    """(query_id, rank, id, path, start_line, end_line, score). ``queries``: query_id, text; ``points``: id, path, symbol,
    code, start_line, end_line, modified. Filters are applied to ``points`` before, where the scan can use them."""
    done = postprocess.finish(scored(queries, points), per_path, limit)
    return done.select("query_id", "rank", "id", "path", "start_line", "end_line", "score")


def feedback_search(queries: DataFrame, points: DataFrame, limit: int = 10, terms: int = 4) -> DataFrame:
    """As ``search`` with a second pass: the symbols and paths of a query's first results give ``terms`` words, and the list of
    the query with these words is fused with its own, weighed 0.6."""
    first = cut_lineage(search(queries, points, 8))
    named = points.select("id", F.concat_ws(" ", "symbol", "path").alias("text"))
    more = expand.feedback_terms(first, named, 8, terms).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("_more"))
    wider = queries.join(more, "query_id").select("query_id", F.concat_ws(" ", "text", "_more").alias("text"))
    q, c = _texts(cut_lineage(wider), points)
    second = retrieve.lexical_scan(q, c, CANDIDATES, norm_corpus=True)
    return retrieve.fuse([(first, 1.0), (second, 0.6)], limit=limit)
