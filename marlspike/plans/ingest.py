"""Indexing as one job over all files: skip what is unchanged, chunk, tag, embed, and merge with what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import chunking, extract, incremental
from ..session import cut_lineage
from ..sources.files import language
from .hybrid import declared_symbol

COLUMNS = ["id", "path", "file_hash", "language", "symbol", "start_line", "end_line", "code", "calls", "information", "vector"]


def points_of(files: DataFrame, embed: Callable[[Column], Column], max_lines: int = 120, overlap: int = 20) -> DataFrame:
    """Points of files (path, text, file_hash): a row for each line chunk, with its symbol, calls, information line and vector."""
    chunks = chunking.line_chunks(files, "path", "text", max_lines, overlap).withColumnRenamed("id", "path").withColumnRenamed("chunk_text", "code")
    c = chunks.join(files.select("path", "file_hash"), "path").withColumn("language", language(F.col("path")))
    return c.select(
        tokens.point_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("code")).alias("id"), "path", "file_hash", "language", declared_symbol(F.col("code")).alias("symbol"),
        "start_line", "end_line", "code", extract.calls(F.col("code")).alias("calls"),
        chunking.information(F.col("language"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("code")).alias("information"), embed(F.col("code")).alias("vector"),
    )


def index(files: DataFrame, held: DataFrame, embed: Callable[[Column], Column], max_lines: int = 120, overlap: int = 20) -> DataFrame:
    """The points after indexing ``files`` over the points ``held``.

    Files whose hash is unchanged keep their points untouched; points of files that are gone or changed are dropped. A new
    chunk takes over the vector of an old one of equal code, each old one once; only what is left is embedded.
    """
    known = held.select("path", "file_hash").distinct()
    fresh = cut_lineage(files.where(F.col("text").isNotNull()).join(known, ["path", "file_hash"], "left_anti"))
    stay = held.join(files.select("path", "file_hash").distinct(), ["path", "file_hash"], "left_semi")
    old = held.join(fresh.select("path"), "path", "left_semi").select("id", "code", "vector")
    bare = points_of(fresh, lambda c: F.lit(None), max_lines, overlap).drop("vector")
    reused = incremental.reuse_vectors(bare, old, ["code"])
    made = reused.withColumn("vector", F.coalesce("vector", embed(F.col("code"))))
    return stay.select(*COLUMNS).unionByName(made.select(*COLUMNS))
