"""Maintenance of point tables: rename, delete, pages, deltas, memories, samples, layouts and backups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import rules, tokens


def indexed_hashes(files: DataFrame) -> DataFrame:
    """(path, file_hash): the hash that each path was last indexed with."""
    return files.groupBy("path").agg(F.max_by("file_hash", F.struct("ingested_at", "file_hash")).alias("file_hash"))


def delete_paths(points: DataFrame, gone: DataFrame) -> DataFrame:
    """Points whose path is not among the deleted ones."""
    return points.join(gone.select("path").distinct(), "path", "left_anti")


def rename_paths(points: DataFrame, moves: DataFrame) -> DataFrame:
    """Points of moved files (old_path, new_path) at their new place: new path, new point id, all else kept."""
    m = moves.select(F.col("old_path").alias("path"), "new_path").distinct()
    placed = points.join(m, "path", "left").withColumn("path", F.coalesce("new_path", "path"))
    return placed.withColumn("point_id", tokens.point_id(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("chunk_text"))).drop("new_path")


def page(points: DataFrame, key: str, after: object | None, size: int) -> DataFrame:
    """The next ``size`` rows by key: a filter that reaches the scan and a top-k, so no page reads those before it."""
    rest = points if after is None else points.where(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(size)


def delta_operations(changes: DataFrame, moves: DataFrame) -> DataFrame:
    """(seq, operation): one JSON operation for each change but the unchanged; a move stands for its deletion and creation."""
    moved = moves.select(F.col("new_path").alias("path"), F.lit("moved").alias("op"), "file_hash", "old_path")
    ends = moves.select(F.explode(F.array("old_path", "new_path")).alias("path"))
    plain = changes.where("op <> 'unchanged'").join(ends, "path", "left_anti").select("path", "op", "file_hash", F.lit(None).cast("string").alias("old_path"))
    return plain.unionByName(moved).select("path", F.to_json(F.struct("op", "path", "file_hash", "old_path")).alias("operation"))


def apply_delta(manifest: DataFrame, operations: DataFrame) -> DataFrame:
    """(path, file_hash) of a manifest after JSON operations; paths that leave the tree (``..``) or are absolute are refused."""
    o = operations.select(F.from_json("operation", "op string, path string, file_hash string, old_path string").alias("o")).select("o.*")
    safe = o.where(~F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"))
    gone = safe.where("op in ('deleted', 'updated', 'created')").select("path").union(safe.where("op = 'moved'").select("old_path")).distinct()
    return manifest.select("path", "file_hash").join(gone, "path", "left_anti").unionByName(safe.where("op <> 'deleted'").select("path", "file_hash"))


def memory_points(notes: DataFrame, text: str, kind: Column) -> DataFrame:
    """(memory_id, kind, information, copies): each distinct note once, named by its content, so storing it again changes nothing."""
    n = notes.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(F.substring(F.sha1(text), 1, 16).alias("memory_id"), F.col(text).alias("information"), kind.alias("kind"))
    return n.groupBy("memory_id").agg(F.min("kind").alias("kind"), F.min("information").alias("information"), F.count(F.lit(1)).alias("copies"))


def backup_memories(points: DataFrame, path: str, kind: str = "kind", source: str = "source") -> None:
    """Memory-like points as JSON lines."""
    points.where(rules.memory_like(F.col("path"), F.col(kind), F.col(source))).write.mode("overwrite").json(path)


def restore_memories(spark: SparkSession, path: str, schema: StructType | str, embed=None, text: str = "information") -> DataFrame:
    """Points of a backup; vectors are made anew by ``embed`` where one is given."""
    rows = spark.read.schema(schema).json(path)
    return rows if embed is None else rows.withColumn("vector", embed(F.col(text)))


def sampled(events: DataFrame, key: str, share: float) -> DataFrame:
    """A share of the events by a hash of their key: the same events on every run."""
    return events.where(tokens.token_hash(F.col(key).cast("string")) % 10_000 < int(share * 10_000))


def retained(events: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Events of the last ``days``."""
    return events.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def write_points(points: DataFrame, path: str, by: str = "repo", files: int = 64) -> None:
    """A table laid out for pruning: ranges of (by, path) and sorted within, so that a filter on either skips most row groups."""
    points.repartitionByRange(files, by, "path").sortWithinPartitions(by, "path").write.mode("overwrite").parquet(path)


def schema_problems(have: StructType, want: StructType) -> list[str]:
    """What a table lacks or holds in another type; an empty list is a valid collection."""
    held = {f.name: f.dataType for f in have.fields}
    out = [f"missing {f.name}" for f in want.fields if f.name not in held]
    return out + [f"{f.name} is {held[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in want.fields if f.name in held and held[f.name] != f.dataType]


def next_sequence(log: DataFrame, workspace: str) -> DataFrame:
    """(workspace, seq): the number of each workspace's next upload."""
    return log.groupBy(workspace).agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("seq"))


def path_activity(changes: DataFrame, path: str, at: str, author: str) -> DataFrame:
    """(path, last, churn, authors) over the commits of each path."""
    return changes.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("path")).agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("churn"), F.count_distinct(author).alias("authors"))


def latest_runs(runs: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """(group, order, value, before): each run's value with that of the run before."""
    return runs.withColumn("before", F.lag(value).over(Window.partitionBy(group).orderBy(order)))
