"""Joins by time and by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(rows: DataFrame, key: str, at: str, order: str, wanted: Column, unit: str = "hour") -> DataFrame:
    """``rows`` with ``last``: the greatest ``order`` of the wanted rows of the same key that come before, by (at, order).

    ``order`` must rise with time. A key's rows are split by time unit, so a hot key is many groups: within a unit a
    running maximum, and across units one of the per-unit maxima, of which there are few.
    """
    marked = rows.withColumn("_unit", F.date_trunc(unit, at)).withColumn("_hit", F.when(wanted, F.col(order)))
    per = marked.groupBy(key, "_unit").agg(F.max("_hit").alias("_m"))
    before = per.withColumn("_carry", F.max("_m").over(Window.partitionBy(key).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1))).drop("_m")
    inner = Window.partitionBy(key, "_unit").orderBy(at, order).rowsBetween(Window.unboundedPreceding, -1)
    joined = marked.join(before, [key, "_unit"])
    return joined.withColumn("last", F.coalesce(F.max("_hit").over(inner), "_carry")).drop("_unit", "_hit", "_carry")


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of rows of equal key whose [start, end] ranges overlap: an equi-join on the key and on bins of ``width``, each
    pair kept in the first bin that both touch. Columns of the right side are prefixed with r_."""
    bins = lambda df, p: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{p}start") / width), F.floor(F.col(f"{p}end") / width))))
    r = right.select([F.col(c).alias(c if c == key else f"r_{c}") for c in right.columns])
    met = bins(left, "").join(bins(r, "r_"), [key, "_bin"])
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width))
    return met.where((F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end")) & (F.col("_bin") == first)).drop("_bin")
