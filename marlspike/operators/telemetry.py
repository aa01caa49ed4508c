"""Analytics over trace spans: usage, trends, breakdowns, outliers, errors, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import rounded


def tool_usage(spans: DataFrame) -> DataFrame:
    """(name, calls, avg, p90) by span name."""
    return spans.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), rounded(F.avg("duration")).alias("avg_duration"), rounded(F.percentile("duration", 0.9)).alias("p90_duration"))


def hourly_trend(spans: DataFrame) -> DataFrame:
    return spans.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("calls"), rounded(F.avg("duration")).alias("avg_duration"))


def trend_label(series: DataFrame, group: str, at: str, value: str, ends: int = 3, margin: float = 0.05) -> DataFrame:
    """(group, first_mean, last_mean, trend): the mean of the last points against that of the first ones."""
    up, down = Window.partitionBy(group).orderBy(F.asc(at)), Window.partitionBy(group).orderBy(F.desc(at))
    placed = series.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down))
    means = placed.groupBy(group).agg(F.avg(F.when(F.col("_u") <= ends, F.col(value))).alias("a"), F.avg(F.when(F.col("_d") <= ends, F.col(value))).alias("b"))
    label = F.when(F.col("b") > F.col("a") * (1 + margin), "rising").when(F.col("b") < F.col("a") * (1 - margin), "falling").otherwise("stable")
    return means.select(group, rounded("a").alias("first_mean"), rounded("b").alias("last_mean"), label.alias("trend"))


def hour_profile(spans: DataFrame, least_calls: int = 1) -> DataFrame:
    """(name, peak_hour, trough_hour, peak_ratio, variation) of the mean duration by hour of the day."""
    hours = spans.groupBy("name", F.hour("ts").alias("h")).agg(F.avg("duration").alias("d"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_calls).withColumn("d", rounded("d"))
    at = lambda f, sign: f("h", F.struct(F.col("d"), sign * F.col("h")))  # noqa: E731 - ties go to the earlier hour
    return hours.groupBy("name").agg(
        at(F.max_by, F.lit(-1)).cast("int").alias("peak_hour"), at(F.min_by, F.lit(1)).cast("int").alias("trough_hour"),
        rounded(F.max("d") / F.min("d")).alias("peak_ratio"), rounded(F.stddev_pop("d") / F.avg("d")).alias("variation"),
    )


def breakdown(spans: DataFrame, share_of: Column) -> DataFrame:
    """(part, calls, avg, p90, share of the total duration); the total is a one-row aggregate, not an unpartitioned window."""
    total = spans.agg(F.sum("duration").alias("_t"))
    per = spans.groupBy(share_of.alias("part")).agg(F.count(F.lit(1)).alias("calls"), F.avg("duration").alias("_a"), F.percentile("duration", 0.9).alias("_p"), F.sum("duration").alias("_s"))
    return per.join(F.broadcast(total)).select("part", "calls", rounded("_a").alias("avg_duration"), rounded("_p").alias("p90_duration"), rounded(F.col("_s") / F.col("_t")).alias("share"))


def without_outliers(spans: DataFrame, group: str, deviations: float = 3.0, least_left: int = 10) -> DataFrame:
    """Drops values beyond so many population deviations where enough of the group remain."""
    stats = spans.groupBy(group).agg(F.avg("duration").alias("_m"), F.stddev_pop("duration").alias("_s"))
    marked = spans.join(stats, group).withColumn("_ok", F.abs(F.col("duration") - F.col("_m")) <= deviations * F.col("_s"))
    left = marked.groupBy(group).agg(F.count_if("_ok").alias("_left"))
    return marked.join(left, group).where(F.col("_ok") | (F.col("_left") < least_left)).drop("_m", "_s", "_ok", "_left")


def error_patterns(spans: DataFrame, is_error: Column, by: list[str | Column]) -> DataFrame:
    """Errors by their attributes with their share of all spans."""
    total = spans.agg(F.count(F.lit(1)).alias("_n"))
    per = spans.where(is_error).groupBy(*by).agg(F.count(F.lit(1)).alias("errors"))
    return per.join(F.broadcast(total)).withColumn("rate", rounded(F.col("errors") / F.col("_n"), 8)).drop("_n")


def number_or_zero(attributes: Column, path: str) -> Column:
    """A number out of a JSON attribute; 0 where it is missing or no number."""
    return F.coalesce(F.get_json_object(attributes, path).try_cast("double"), F.lit(0.0))
