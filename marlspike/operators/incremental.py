"""Maintenance of point tables by content hash: classify, move, prune, upsert, reuse, publish."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, op): created, updated, deleted or unchanged, by one full outer join of two manifests (path, file_hash)."""
    o, n = old.select("path", F.col("file_hash").alias("_o")), new.select("path", F.col("file_hash").alias("_n"))
    op = F.when(F.col("_o").isNull(), "created").when(F.col("_n").isNull(), "deleted").when(F.col("_o") == F.col("_n"), "unchanged").otherwise("updated")
    return o.join(n, "path", "full").select("path", op.alias("op"), F.coalesce("_n", "_o").alias("file_hash"))


def moves(changes: DataFrame) -> DataFrame:
    """(old_path, new_path, file_hash): deleted and created files of equal content, paired one to one in path order."""
    w = Window.partitionBy("file_hash").orderBy("path")
    gone = changes.where("op = 'deleted'").select("file_hash", F.col("path").alias("old_path"), F.row_number().over(w).alias("_rn"))
    come = changes.where("op = 'created'").select("file_hash", F.col("path").alias("new_path"), F.row_number().over(w).alias("_rn"))
    return gone.join(come, ["file_hash", "_rn"]).select("old_path", "new_path", "file_hash")


def prune(points: DataFrame, manifest: DataFrame) -> DataFrame:
    """Points whose file is gone or whose content has changed."""
    return points.join(manifest.select("path", "file_hash").distinct(), ["path", "file_hash"], "left_anti")


def upsert(points: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """The last write of each key wins; of equal versions the incoming one. The winner is found map-side combined."""
    columns = points.columns
    both = points.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    best = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(version, "_new")).alias("_v"))
    return best.select("_v.*")


def reuse_vectors(new: DataFrame, old: DataFrame, key: list[str], vector: str = "vector") -> DataFrame:
    """New rows with the vector of an old row of equal key, each old row used once; null where it must be made anew."""
    n = new.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("id")))
    o = old.select(*key, F.col(vector), F.col("id").alias("_old")).withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("_old")))
    return n.join(o.drop("_old"), [*key, "_rn"], "left").drop("_rn")


def symbol_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol_id, state): unchanged where the content hash is equal, else changed; deletions are not listed."""
    o = old.select("symbol_id", F.col("content_hash").alias("_h"))
    return new.join(o, "symbol_id", "left").select("symbol_id", F.when(F.col("_h") == F.col("content_hash"), "unchanged").otherwise("changed").alias("state"))


def snapshot_only(points: DataFrame, run: str, kind: str) -> DataFrame:
    """Drops rows of a kind that another run left."""
    return points.where(~((F.col("kind") == kind) & (F.col("run_id") != run)))


def publish(df: DataFrame, root: str, name: str, version: str) -> str:
    """Writes a new version beside the old ones and then adds a pointer row with the next number.

    Pointer rows are only ever added, and Spark moves a file into place when it is whole, so readers see the version before or
    this one. A version that was written but not pointed to is no part of the table.
    """
    target = f"{root}/{name}/version={version}"
    df.write.mode("overwrite").parquet(target)
    spark = df.sparkSession
    _point(spark, root, name, target)
    return target


def _point(spark: SparkSession, root: str, name: str, target: str) -> None:
    try:
        last = spark.read.schema(_POINTER).json(f"{root}/{name}/_current").agg(F.max("seq")).first()[0] or 0
    except AnalysisException:  # the first version
        last = 0
    spark.createDataFrame([(last + 1, target)], _POINTER).coalesce(1).write.mode("append").json(f"{root}/{name}/_current")


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version that the last pointer names."""
    rows = spark.read.schema(_POINTER).json(f"{root}/{name}/_current")
    return spark.read.parquet(rows.agg(F.max_by("target", "seq")).first()[0])


def roll_back(spark: SparkSession, root: str, name: str, version: str) -> None:
    """Points to an older version again."""
    _point(spark, root, name, f"{root}/{name}/version={version}")


_POINTER = "seq bigint, target string"
