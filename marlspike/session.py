"""Session settings, lineage cuts and the rule for current rows that all operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "marlspike", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the library expects: UTC, AQE and Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | (conf or {})
    spark = builder.config(map=settings).getOrCreate()
    if not spark.sparkContext.master.startswith("local["):
        ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the cluster names; on a local master, as in tests, one of our own where none is set.

    On a cluster a folder of this machine would be no use to the others, so a missing setting is an error there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="marlspike-ckpt-"))
    return jsc.getCheckpointDir().get()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors of a session on which it is not installed."""
    import shutil
    from pathlib import Path

    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="marlspike-")) / package.name
    spark.sparkContext.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written copy.

    The files survive the loss of an executor, and a result that is read several times is computed once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_rows(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for steps that take much time for few bytes.

    A table of more partitions than cores, as any large one is, stays as it is and is not shuffled. Meant for tables as read or
    checkpointed: a plan with shuffles would be run to count its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def current_rows(df: DataFrame, key: str, columns: list[str], order: str = "ingested_at") -> DataFrame:
    """One row per ``key``: the one with the greatest ``order``; ties on it are identical rows.

    ``max_by`` has a partial (map-side) phase, so a key that holds a third of all rows is reduced before the
    shuffle. Rows without a key are left out; a null ``order`` counts as the oldest. Only ``columns`` are read.
    """
    rest = [c for c in columns if c != key]
    picked = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_k"),
        F.coalesce(F.col(order), F.lit(-(2**62)).cast("bigint")).alias("_o"),
        F.struct(*[F.col(c).alias(c) for c in rest]).alias("_v"),
    )
    best = picked.groupBy("_k").agg(F.max_by("_v", "_o").alias("_v"))
    return best.select(F.col("_k").alias(key), *[F.col("_v")[c].alias(c) for c in rest])


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def rounded(col: Column | str, digits: int = 6) -> Column:
    """Half-up rounding used wherever a score is compared or ranked."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def current_rows_where(df: DataFrame, key: str, columns: list[str], keep: Column, order: str = "ingested_at") -> DataFrame:
    """``current_rows`` of which only those that satisfy ``keep`` are wanted.

    The latest version of each key is found over the narrow pair (key, order) alone, map-side combined; wide columns
    are shuffled only for the rows that ``keep`` leaves. Use it where ``keep`` is selective.
    """
    stamp = F.coalesce(F.col(order), F.lit(-(2**62)).cast("bigint"))
    rest = [c for c in columns if c != key]
    latest = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(stamp).alias("_o"))
    wanted = df.where(F.col(key).isNotNull() & keep).select(F.col(key).alias("_k"), stamp.alias("_o"), *[F.col(c).alias(c) for c in rest])
    return wanted.join(latest, ["_k", "_o"]).dropDuplicates(["_k"]).select(F.col("_k").alias(key), *rest)
