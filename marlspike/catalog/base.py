"""Registration of queries, and the tables as the operators want them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import current_rows, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def latest(name: str, key: str) -> str:
    """SQL of the current rows of a table."""
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) = 1)"


CHUNKS = latest("code_chunk", "chunk_id")
FILES = latest("source_file", "file_id")
SYMBOLS = latest("code_symbol", "symbol_id")
SIGNATURES = latest("pattern_signature", "sig_id")

#: The identifier split in the dialect of RE2, which has no lookahead.
SQL_TOKENS = "list_transform(regexp_extract_all(regexp_replace(coalesce({0}, ''), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x))"
SQL_STOP = "('the','a','an','of','in','on','for','and','or','to','with','by','is','are','be','this','that')"


def sql_tokens(column: str, stop: bool = False) -> str:
    t = SQL_TOKENS.format(column)
    return f"list_filter({t}, lambda t: t NOT IN {SQL_STOP})" if stop else t


def chunks(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, root, "code_chunk"), "chunk_id", list(columns)).withColumnRenamed("chunk_id", "id")


def files(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, root, "source_file"), "file_id", list(columns))


def symbols(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, root, "code_symbol"), "symbol_id", list(columns))


def spans(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("name"), F.col("value").alias("duration"), F.col("props").alias("attributes"))
