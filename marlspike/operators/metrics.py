"""Ranking quality, run statistics and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import rounded


def ranking_quality(judged: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, mrr, ndcg, recall, precision_returned, precision_k, hit) of lists with columns rank, relevant and n_relevant."""
    rel = F.when(F.col("relevant") & (F.col("rank") <= k), 1.0).otherwise(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.max("n_relevant"), F.lit(k)).cast("int"), F.lit(1))), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + F.lit(1.0)))
    found = F.sum(rel)
    return judged.groupBy("query_id").agg(
        rounded(F.coalesce(F.lit(1.0) / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0))).alias("mrr"),
        rounded(F.when(F.max("n_relevant") > 0, F.sum(rel / F.log2(F.col("rank") + F.lit(1.0))) / ideal).otherwise(0.0)).alias("ndcg"),
        rounded(F.when(F.max("n_relevant") > 0, found / F.max("n_relevant")).otherwise(0.0)).alias("recall"),
        rounded(found / F.least(F.count(F.lit(1)), F.lit(k))).alias("precision_returned"),
        rounded(found / k).alias("precision_k"),
        (found > 0).cast("int").alias("hit"),
    )


def pass_at_k(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, passed): whether every true id (query_id, id) of a query is among its first k; queries without truth have no row."""
    top = ranked.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("_hit")).distinct()
    met = truth.select("query_id", "id").distinct().join(top, ["query_id", "id"], "left")
    return met.groupBy("query_id").agg((F.count("_hit") == F.count(F.lit(1))).alias("passed"))


def latency_summary(values: DataFrame, group: list[str], value: str, accuracy: int | None = None) -> DataFrame:
    """Linear-interpolated percentiles, extremes, mean and sample deviation.

    Percentiles are exact, which holds all distinct values of a group in one buffer; with ``accuracy`` they are sketches whose
    rank is off by at most 1 / accuracy, of bounded size for groups of any number of rows.
    """
    of = lambda p: F.percentile(value, p) if accuracy is None else F.percentile_approx(value, p, accuracy).cast("double")
    quantiles = [of(p).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))]
    stats = values.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *quantiles, F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"))
    return stats.select(*group, "n", *[F.round(c, 2).alias(c) for c in ("p50", "p90", "p95", "p99", "least", "most", "mean", "deviation")])


def kendall_tau(pairs: DataFrame) -> DataFrame:
    """(query_id, tau) of two ranks a and b of each item; ties count as discordant, as no pair of a list should tie."""
    x, y = pairs.alias("x"), pairs.alias("y")
    both = x.join(y, (F.col("x.query_id") == F.col("y.query_id")) & (F.col("x.id") < F.col("y.id")))
    same = F.when((F.col("x.a") - F.col("y.a")) * (F.col("x.b") - F.col("y.b")) > 0, 1).otherwise(-1)
    return both.groupBy(F.col("x.query_id").alias("query_id")).agg(rounded(F.avg(same.cast("double"))).alias("tau"))


#: Two-sided 95 % points of Student's t by degrees of freedom; 1.96 beyond.
T_95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 15: 2.131, 20: 2.086, 30: 2.042}


def mean_interval(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """Mean with a 95 % confidence interval."""
    stats = values.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    t: Column = F.lit(1.96)
    for df in sorted(T_95, reverse=True):
        t = F.when(F.col("n") - 1 <= df, F.lit(T_95[df])).otherwise(t)
    half = t * F.col("_s") / F.sqrt("n")
    return stats.select(*group, "n", rounded("mean").alias("mean"), rounded(F.col("mean") - half).alias("low"), rounded(F.col("mean") + half).alias("high"))


def variant(key: Column, n: int) -> Column:
    """A stable share of 0 to n - 1 by the first 32 bits of a key's md5."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % n).cast("bigint")


def experiment_outcome(runs: DataFrame, least_runs: int = 50, margin: float = 0.05) -> DataFrame:
    """(variant, runs, success_rate, avg_latency, winner): the best variant wins by more than the margin, all with enough runs."""
    per = runs.groupBy("variant").agg(F.count(F.lit(1)).alias("runs"), F.avg(F.col("success").cast("double")).alias("_r"), F.avg("latency").alias("_l"))
    w = Window.orderBy(F.desc("_r"), "variant")  # a handful of variants
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    ranked = per.withColumn("_n", F.lead("_r").over(w)).withColumn("_first", F.row_number().over(w)).withColumn("_least", F.min("runs").over(every))
    win = (F.col("_first") == 1) & (F.col("_r") - F.col("_n") > margin) & (F.col("_least") >= least_runs)
    return ranked.select("variant", "runs", rounded("_r").alias("success_rate"), rounded("_l").alias("avg_latency"), F.coalesce(win, F.lit(False)).alias("winner"))


def significance(runs: DataFrame, group: list[str], variant_col: str, value: str) -> DataFrame:
    """(group, effect, significant): variant 1 against variant 0; significant where their 95 % intervals do not meet."""
    i = mean_interval(runs, [*group, variant_col], value)
    side = lambda v, p: i.where(F.col(variant_col) == v).select(*group, *[F.col(c).alias(f"{p}_{c}") for c in ("mean", "low", "high")])
    both = side(0, "a").join(side(1, "b"), group)
    apart = (F.col("a_high") < F.col("b_low")) | (F.col("b_high") < F.col("a_low"))
    return both.select(*group, rounded(F.col("b_mean") - F.col("a_mean")).alias("effect"), apart.alias("significant"))


def report_deltas(before: DataFrame, after: DataFrame, key: str, value: str, margin: float = 0.05) -> DataFrame:
    """(key, delta, verdict): how a metric moved between two reports; a move within the margin counts as the same."""
    met = before.select(key, F.col(value).alias("_a")).join(after.select(key, F.col(value).alias("_b")), key)
    d = met.withColumn("delta", rounded(F.col("_b") - F.col("_a")))
    verdict = F.when(F.col("delta") > margin * F.col("_a"), "better").when(F.col("delta") < -margin * F.col("_a"), "worse").otherwise("same")
    return d.select(key, "delta", verdict.alias("verdict"))
