"""The pN_ queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import current_rows, current_rows_where, cut_lineage, table
from . import clustering, documented_code, leakage, near_duplicates, nearest_vectors, residue, splitting, tokenizing


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    chunks = current_rows(table(spark, root, "code_chunk"), "chunk_id", ["chunk_text"])
    pairs = near_duplicates.near_duplicate_pairs(chunks, "chunk_id", "chunk_text")
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_classes(spark: SparkSession, root: str) -> DataFrame:
    chunks = current_rows(table(spark, root, "code_chunk"), "chunk_id", ["chunk_text"])
    return near_duplicates.near_duplicate_classes(chunks, "chunk_id", "chunk_text").withColumnRenamed("item", "chunk_id")


def _pieces(spark: SparkSession, root: str) -> DataFrame:
    long = splitting.line_count(F.col("chunk_text")) > splitting.MAX_LINES
    chunks = current_rows_where(table(spark, root, "code_chunk"), "chunk_id", ["start_line", "chunk_text"], long)
    return splitting.split_oversized(chunks, "chunk_id", "chunk_text", "start_line").withColumnRenamed("item_id", "chunk_id")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root).select("chunk_id", "piece_start", "piece_end")


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root)


def _documented(spark: SparkSession, root: str) -> DataFrame:
    files = current_rows(table(spark, root, "source_file"), "file_id", ["path", "language", "text"])
    symbols = current_rows(table(spark, root, "code_symbol"), "symbol_id", ["file_id", "name", "kind", "start_line", "end_line", "signature", "docstring"])
    return documented_code.documented_functions(files, symbols)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _documented(spark, root).select("file_id", "start_line").distinct()


def p5_pairs(spark: SparkSession, root: str) -> DataFrame:
    return _documented(spark, root)


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokenizing.encode_corpus(table(spark, root, "documents"))


def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    """The texts made from their ids again."""
    return tokenizing.decode_corpus(tokenizing.encode_corpus(table(spark, root, "documents")))


def _clusters(spark: SparkSession, root: str) -> clustering.Clusters:
    rows = current_rows(table(spark, root, "discovered_pattern"), "pattern_id", ["centroid"])
    return clustering.Clusters(rows, "pattern_id", "centroid", 64)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _clusters(spark, root).members().select(F.col("cluster").alias("cluster_id"), F.col("id").alias("pattern_id"))


def _with_members(spark: SparkSession, root: str, shape: DataFrame, by: list[str]) -> DataFrame:
    """``shape`` with its typical members' exemplars, cluster_size and coherence_score."""
    rows = current_rows(table(spark, root, "discovered_pattern"), "pattern_id", ["exemplars", "cluster_size", "coherence_score"])
    typical = shape.select(*by, F.posexplode("typical").alias("rank", "pattern_id")).join(rows, "pattern_id")
    listed = typical.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "pattern_id", "cluster_size", "coherence_score", "exemplars"))).alias("members"))
    return shape.drop("typical").join(listed, by).withColumnsRenamed({"cluster": "cluster_id", "community": "community_id"})


def p2_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Each cluster with its size and its most typical members, these with their exemplars, cluster_size and coherence_score."""
    return _with_members(spark, root, cut_lineage(_clusters(spark, root).clusters()), ["cluster"])


def p2_communities(spark: SparkSession, root: str) -> DataFrame:
    """Each community of each cluster with its size, coherence and members of the highest internal weighted degree."""
    return _with_members(spark, root, cut_lineage(_clusters(spark, root).communities()), ["cluster", "community"])


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue_records(table(spark, root, "documents"))


def p8_scores(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue_scores(table(spark, root, "documents"))


#: Cosine 0.7 as a distance of vectors of length 1.
COSINE_07 = (2 - 2 * 0.7) ** 0.5


def _neighbours(spark: SparkSession, root: str, field: str) -> DataFrame:
    if field == "spectral_features":
        rows = current_rows(table(spark, root, "pattern_signature"), "sig_id", ["spectral_features"])
        return nearest_vectors.nearest_vectors(rows, "sig_id", "spectral_features", 8, 0.2)
    rows = current_rows(table(spark, root, "discovered_pattern"), "pattern_id", ["centroid"])
    return nearest_vectors.nearest_vectors(rows, "pattern_id", "centroid", 64, COSINE_07, unit=True)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    parts = [nearest_vectors.neighbour_pairs(_neighbours(spark, root, f)).select(F.lit(f).alias("vector_field"), "id_a", "id_b") for f in ("spectral_features", "centroid")]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_matches(spark, root).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_documents(table(spark, root, "documents"), table(spark, root, "eval_item"))


def p7_proximity(spark: SparkSession, root: str) -> DataFrame:
    tests = leakage.test_items(table(spark, root, "eval_item"), "item_id", "text")
    return leakage.PositionalIndex(table(spark, root, "documents"), tests).proximity_matches()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p2_communities": p2_communities,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_found": p7_found,
    "p7_matches": p7_matches,
    "p7_proximity": p7_proximity,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
}

ORACLES: dict[str, str] = {
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
