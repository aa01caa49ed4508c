"""Structured Streaming over change feeds and event logs; every job can run with availableNow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..session import ensure_checkpoint_dir


def read_events(spark: SparkSession, folder: str, pattern: str, schema: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch).parquet(folder)


def debounced(events: DataFrame, key: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(key, first, last, changes): bursts of changes of a key, closed when it has been quiet for ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("changes"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("_w")


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of equal requests within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): tumbling windows by event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("_w.start").alias("start"), "event_type", "n", "total")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns the rows written: files in the shared checkpoint folder.

    In ``append`` mode a group appears once its watermark has passed, so those still open at the end of the feed are missing;
    ``drain_all`` has them.
    """
    where = _folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/rows")


def drain_all(stream: DataFrame, key: list[str]) -> DataFrame:
    """Runs an aggregation over what there is and returns the last state of every group, open ones too.

    Each micro-batch writes the groups that it changed; of a group's versions the one of the last batch counts.
    """
    where = _folder(stream.sparkSession)

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("_batch", F.lit(batch).cast("bigint")).write.mode("overwrite").parquet(f"{where}/rows/batch={batch}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/state").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in stream.columns if c not in key]
    schema = stream.select("*", F.lit(0).cast("bigint").alias("_batch")).schema
    rows = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{where}/rows")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("_v")).select(*key, "_v.*")


def bursts(stream: DataFrame, feed: DataFrame, key: str, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``debounced`` with the bursts that are still open when the stream has read ``feed`` up.

    Session windows can only be appended, once they are closed. The open ones are made from those rows of the feed that come
    after a key's last closed burst; both parts together hold every row once.
    """
    closed = drain(debounced(stream, key, gap, late))
    ends = closed.groupBy(key).agg(F.max("last").alias("_end"))
    rows = feed.withColumn("ts", F.col("ts").cast("timestamp")).join(ends, key, "left").where(F.col("_end").isNull() | (F.col("ts") > F.col("_end")))
    still = rows.groupBy(F.session_window("ts", gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("changes"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("_w")
    return closed.unionByName(still)


def _folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{spark.sql('select uuid()').first()[0]}"


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n): sliding windows by event time."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, step).alias("_w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("start"), "event_type", "n")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands micro-batches to ``handle`` until the feed is read up."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def request_fingerprint(columns: list[str]) -> Column:
    """One hash over a request's normalised fields: text trimmed, lower-cased, blanks folded; null is empty."""
    plain = [F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))), r"\s+", " ") for c in columns]
    return F.sha2(F.concat_ws("\u0001", *plain), 256)


def distinct_requests(events: DataFrame, columns: list[str], ttl_seconds: int = 60) -> DataFrame:
    """Requests that are not repeated within ``ttl_seconds`` of the first of their kind; a repeat does not renew the time.

    In batch, for a bounded span of time: each fingerprint's distinct times (8 bytes each, in one row) are folded in order; one
    that comes ``ttl_seconds`` or more after the period's first opens the next. ``first_seen`` is the form for endless feeds.
    """
    f = events.withColumn("_f", request_fingerprint(columns)).withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    times = f.groupBy("_f").agg(F.array_sort(F.collect_set("_t")).alias("_all"))
    none = F.array().cast("array<bigint>")
    opens = F.aggregate("_all", none, lambda s, t: F.when((F.size(s) == 0) | (t - F.element_at(s, -1) >= ttl_seconds * 1_000_000), F.concat(s, F.array(t))).otherwise(s))
    firsts = times.select("_f", F.explode(opens).alias("_t"))
    kept = f.join(firsts, ["_f", "_t"]).groupBy("_f", "_t").agg(F.min(F.struct(*events.columns)).alias("_v"))
    return kept.select("_v.*")


def similar_request(a: Column, b: Column, least: float = 0.9) -> Column:
    """Whether two requests' words overlap by at least ``least``."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9_]+"), 0))
    return tokens.jaccard(words(a), words(b)) >= least


def apply_changes(held: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, action) for a batch of change events (path, event, file_hash, ts): the last event of a path counts; ``skip`` where
    the held hash is equal, ``delete`` for what is gone, ``smart`` for a known path, ``full`` for a new one."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("event", "file_hash"), F.struct("ts", "event")).alias("v")).select("path", "v.*")
    known = held.groupBy("path").agg(F.max("file_hash").alias("_h"))
    gone = F.col("event").isin("deleted", "moved_from")
    action = F.when(gone, F.when(F.col("_h").isNotNull(), "delete").otherwise("skip")).when(F.col("_h") == F.col("file_hash"), "skip").when(F.col("_h").isNotNull(), "smart").otherwise("full")
    return last.join(known, "path", "left").select("path", action.alias("action"))
