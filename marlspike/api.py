"""The search tools as functions over points (id, path, symbol, code, start_line, end_line, modified, calls, imports, language) and
queries (query_id, text). Each returns a DataFrame; filters are those of ``filters.where_filters`` and reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import rules
from .operators import expand, filters, graph, patterns, points as maintenance
from .plans import hybrid, ingest


def repo_search(queries: DataFrame, points: DataFrame, limit: int = 10, per_path: int = 1, **where: object) -> DataFrame:
    return hybrid.search(queries, filters.where_filters(points, where), limit, per_path)


code_search = repo_search


def context_search(queries: DataFrame, points: DataFrame, memories: DataFrame, limit: int = 10, **where: object) -> DataFrame:
    """Code and memories (query_id, id, score) in one list."""
    return graph.blend(repo_search(queries, points, limit, **where), memories, limit)


def search_tests_for(queries: DataFrame, points: DataFrame, limit: int = 10) -> DataFrame:
    return hybrid.search(queries, graph.preset_points(points, "tests"), limit)


def search_config_for(queries: DataFrame, points: DataFrame, limit: int = 10) -> DataFrame:
    return hybrid.search(queries, graph.preset_points(points, "config"), limit)


def search_callers_for(symbols: DataFrame, points: DataFrame, limit: int = 20) -> DataFrame:
    return graph.callers(points, symbols, limit)


def search_importers_for(modules: DataFrame, points: DataFrame) -> DataFrame:
    return graph.importers(points, modules)


def symbol_graph(symbols: DataFrame, points: DataFrame, kind: str = "callers", limit: int = 20) -> DataFrame:
    """``callers`` or ``callees`` of symbols, ``importers`` of modules, or the points that define symbols."""
    if kind == "callers":
        return graph.callers(points, symbols, limit)
    if kind == "callees":
        return graph.callees(points, symbols)
    if kind == "importers":
        return graph.importers(points, symbols.withColumnRenamed("symbol", "module"))
    if kind == "definition":
        return points.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "id", "path", "start_line")
    raise ValueError(f"no such relation: {kind}")


def expand_query(queries: DataFrame, synonyms: DataFrame, limit: int = 12) -> DataFrame:
    return expand.expand(queries, synonyms, limit)


def pattern_search(vectors: DataFrame, queries: DataFrame, dim: int, k: int = 10) -> DataFrame:
    return patterns.similar_to(vectors, queries, dim, k)


def search_commits_for(commits: DataFrame, terms: list[str], fields: dict[str, float], limit: int = 10) -> DataFrame:
    return graph.commit_search(commits, terms, fields, limit)


def change_history_for_path(versions: DataFrame, path: str) -> DataFrame:
    return graph.change_history(versions.where(F.col("path") == path))


def collection_map(points: DataFrame) -> DataFrame:
    return graph.collection_map(points)


def index_files(files: DataFrame, held: DataFrame, embed) -> DataFrame:
    return ingest.index(files, held, embed)


def prune(points: DataFrame, gone: DataFrame) -> DataFrame:
    return maintenance.delete_paths(points, gone)


def memory_store(memories: DataFrame, notes: DataFrame, text: str = "text") -> DataFrame:
    """The memories with the new notes, each distinct note once."""
    new = maintenance.memory_points(notes, text, F.lit("memory")).select("memory_id", "kind", "information")
    return memories.select("memory_id", "kind", "information").unionByName(new.join(memories.select("memory_id"), "memory_id", "left_anti"))


def memory_find(dense: DataFrame, lexical: DataFrame, mode: str = "rrf") -> DataFrame:
    return graph.memory_find(dense, lexical, mode)


def is_memory(points: DataFrame) -> DataFrame:
    return points.where(rules.memory_like(F.col("path"), F.col("kind"), F.col("source")))
