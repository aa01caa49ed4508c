"""Queries of table maintenance: two snapshots are the first and the last version of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, incremental
from ..session import table
from .base import CHUNKS, FILES, SYMBOLS, chunks, files, query, symbols

OLD_NEW = """WITH o AS (SELECT path || '#' || repo AS path, min(file_hash) AS file_hash FROM source_file WHERE ingested_at < 1720000000 AND path IS NOT NULL AND repo IS NOT NULL GROUP BY 1),
 n AS (SELECT path || '#' || repo AS path, max(file_hash) AS file_hash FROM source_file WHERE ingested_at >= 1710000000 AND path IS NOT NULL AND repo IS NOT NULL GROUP BY 1),
 c AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' WHEN o.file_hash = n.file_hash THEN 'unchanged' ELSE 'updated' END AS op, coalesce(n.file_hash, o.file_hash) AS file_hash FROM o FULL JOIN n ON o.path = n.path)"""


def _manifests(spark, root) -> tuple[DataFrame, DataFrame]:
    """What was known before one moment and what has come since an earlier one."""
    f = table(spark, root, "source_file").select(F.concat("path", F.lit("#"), "repo").alias("path"), "file_hash", "ingested_at").where("path is not null")
    old = f.where("ingested_at < 1720000000").groupBy("path").agg(F.min("file_hash").alias("file_hash"))
    new = f.where("ingested_at >= 1710000000").groupBy("path").agg(F.max("file_hash").alias("file_hash"))
    return old, new


@query("change_classification", OLD_NEW + " SELECT path, op, file_hash FROM c")
def change_classification(spark, root):
    return incremental.classify(*_manifests(spark, root))


@query("delta_counts", OLD_NEW + " SELECT op, count(*) AS n FROM c GROUP BY op")
def delta_counts(spark, root):
    return incremental.classify(*_manifests(spark, root)).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("prune_points", f"WITH m AS (SELECT DISTINCT path, file_hash FROM {FILES}) SELECT chunk_id AS id FROM {CHUNKS} c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.path = c.path AND m.file_hash = c.file_hash)")
def prune_points(spark, root):
    return incremental.prune(chunks(spark, root, "path", "file_hash"), files(spark, root, "path", "file_hash")).select("id")


@query("upsert_points", f"SELECT chunk_id, file_hash, ingested_at FROM {CHUNKS}")
def upsert_points(spark, root):
    c = table(spark, root, "code_chunk").select("chunk_id", "file_hash", "ingested_at")
    early = c.where("ingested_at < 1715000000")
    return incremental.upsert(early, c.where("ingested_at >= 1715000000"), "chunk_id", "ingested_at")


@query("vector_reuse", f"""WITH n AS (SELECT chunk_id AS id, md5(chunk_text) AS h, row_number() OVER (PARTITION BY md5(chunk_text) ORDER BY chunk_id) AS r FROM {CHUNKS} WHERE chunk_text IS NOT NULL AND chunk_id % 2 = 0),
 o AS (SELECT md5(chunk_text) AS h, length(chunk_text) AS vector, row_number() OVER (PARTITION BY md5(chunk_text) ORDER BY chunk_id) AS r FROM {CHUNKS} WHERE chunk_text IS NOT NULL AND chunk_id % 2 = 1)
SELECT n.id, n.h, o.vector FROM n LEFT JOIN o ON n.h = o.h AND n.r = o.r""")
def vector_reuse(spark, root):
    """The even ids are the new rows and the odd ones the old: two halves of the whole table."""
    c = chunks(spark, root, "chunk_text").where("chunk_text is not null").select("id", F.md5("chunk_text").alias("h"), F.length("chunk_text").cast("bigint").alias("vector"))
    return incremental.reuse_vectors(c.where("id % 2 = 0").drop("vector"), c.where("id % 2 = 1"), ["h"]).select("id", "h", "vector")


@query("symbol_diff", f"""WITH o AS (SELECT symbol_id, arg_min(content_hash, ingested_at) AS h FROM code_symbol GROUP BY symbol_id) SELECT n.symbol_id, CASE WHEN o.h = n.content_hash THEN 'unchanged' ELSE 'changed' END AS state FROM {SYMBOLS} n JOIN o USING (symbol_id)""")
def symbol_diff(spark, root):
    old = table(spark, root, "code_symbol").groupBy("symbol_id").agg(F.min_by("content_hash", "ingested_at").alias("content_hash"))
    return incremental.symbol_diff(old, symbols(spark, root, "content_hash"))


@query("snapshot_prune", "SELECT run_id, count(*) AS n FROM (SELECT * FROM discovered_pattern QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY ingested_at DESC) = 1) WHERE NOT (coalesce(auto_description, '') = '' AND run_id <> 'mine-00001') GROUP BY run_id")
def snapshot_prune(spark, root):
    from ..session import current_rows

    p = current_rows(table(spark, root, "discovered_pattern"), "pattern_id", ["run_id", "auto_description"]).withColumn("kind", F.coalesce("auto_description", F.lit("")))
    return incremental.snapshot_only(p, "mine-00001", "").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("change_history", "SELECT path, count(*) AS versions, count(DISTINCT file_hash) AS contents, min(last_modified_at) AS first_modified, max(last_modified_at) AS last_modified, max(ingested_at) AS last_ingested FROM source_file GROUP BY path")
def change_history(spark, root):
    return graph.change_history(table(spark, root, "source_file"))


@query("collection_map", f"SELECT repo, count(*) AS points, count(DISTINCT path) AS paths, max(ingested_at) AS last_ingested, max(last_modified_at) AS last_modified FROM {CHUNKS} GROUP BY repo")
def collection_map(spark, root):
    return graph.collection_map(chunks(spark, root, "repo", "path", "ingested_at", "last_modified_at"))


@query("collection_health", f"""WITH p AS (SELECT repo, count(DISTINCT path) AS n FROM {CHUNKS} GROUP BY repo), f AS (SELECT repo, count(DISTINCT path) AS files FROM {FILES} GROUP BY repo)
SELECT f.repo, files, coalesce(n, 0) AS paths, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' WHEN coalesce(n, 0) / files::DOUBLE < 0.1 THEN 'sparse' ELSE 'healthy' END AS state FROM f LEFT JOIN p ON p.repo = f.repo""")
def collection_health(spark, root):
    return graph.collection_health(chunks(spark, root, "repo", "path"), files(spark, root, "repo", "path"))


@query("non_empty_collection", f"SELECT arg_max(repo, n * 1000000 + length(repo)) AS repo, max(n) AS points FROM (SELECT repo, count(*) AS n FROM {CHUNKS} WHERE repo IS NOT NULL GROUP BY repo)")
def non_empty_collection(spark, root):
    n = chunks(spark, root, "repo").where("repo is not null").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max_by("repo", F.struct("n", F.length("repo"))).alias("repo"), F.max("n").alias("points"))
