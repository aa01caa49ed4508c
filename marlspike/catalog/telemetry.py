"""Queries over the event stream: spans, experiments, windows, streams; and joins by time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, metrics, telemetry
from ..session import rounded, table
from ..streaming import feeds
from .base import query, spans

S = "(SELECT event_id, ts, user_id, event_type AS name, value AS duration, props AS attributes FROM events)"
EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("tool_usage", f"SELECT name, count(*) AS calls, round(avg(duration), 6) AS avg_duration, round(quantile_cont(duration, 0.9), 6) AS p90_duration FROM {S} GROUP BY name")
def tool_usage(spark, root):
    return telemetry.tool_usage(spans(spark, root))


@query("hourly_trend", f"SELECT date_trunc('hour', ts)::VARCHAR AS hour, count(*) AS calls, round(avg(duration), 6) AS avg_duration FROM {S} GROUP BY ALL")
def hourly_trend(spark, root):
    return telemetry.hourly_trend(spans(spark, root)).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm:ss"))


@query("trend_label", f"""WITH d AS (SELECT name, date_trunc('day', ts) AS day, round(avg(duration), 6) AS v FROM {S} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY day) AS u, row_number() OVER (PARTITION BY name ORDER BY day DESC) AS w FROM d),
 m AS (SELECT name, avg(CASE WHEN u <= 3 THEN v END) AS a, avg(CASE WHEN w <= 3 THEN v END) AS b FROM r GROUP BY name)
SELECT name, round(a, 6) AS first_mean, round(b, 6) AS last_mean, CASE WHEN b > a * 1.05::DOUBLE THEN 'rising' WHEN b < a * 0.95::DOUBLE THEN 'falling' ELSE 'stable' END AS trend FROM m""")
def trend_label(spark, root):
    daily = spans(spark, root).groupBy("name", F.date_trunc("day", "ts").alias("day")).agg(rounded(F.avg("duration")).alias("v"))
    return telemetry.trend_label(daily, "name", "day", "v")


@query("hour_profile", f"""WITH h AS (SELECT name, hour(ts)::INT AS h, round(avg(duration), 6) AS d FROM {S} GROUP BY ALL)
SELECT name, arg_max(h, d * 1000000 - h)::INT AS peak_hour, arg_min(h, d * 1000000 + h)::INT AS trough_hour, round(max(d) / min(d), 6) AS peak_ratio, round(stddev_pop(d) / avg(d), 6) AS variation FROM h GROUP BY name""")
def hour_profile(spark, root):
    return telemetry.hour_profile(spans(spark, root))


@query("latency_summary", f"""SELECT name, count(*) AS n, round(quantile_cont(duration, 0.5), 2) AS p50, round(quantile_cont(duration, 0.9), 2) AS p90, round(quantile_cont(duration, 0.95), 2) AS p95, round(quantile_cont(duration, 0.99), 2) AS p99,
 round(min(duration), 2) AS least, round(max(duration), 2) AS most, round(avg(duration), 2) AS mean, round(stddev_samp(duration), 2) AS deviation FROM {S} GROUP BY name""")
def latency_summary(spark, root):
    return metrics.latency_summary(spans(spark, root), ["name"], "duration")


@query("latency_breakdown", f"""SELECT CASE WHEN name IN ('click', 'view') THEN 'read' WHEN name = 'error' THEN 'error' ELSE 'write' END AS part, count(*) AS calls, round(avg(duration), 6) AS avg_duration, round(quantile_cont(duration, 0.9), 6) AS p90_duration,
 round(sum(duration) / (SELECT sum(duration) FROM {S}), 6) AS share FROM {S} GROUP BY 1""")
def latency_breakdown(spark, root):
    return telemetry.breakdown(spans(spark, root), F.when(F.col("name").isin("click", "view"), "read").when(F.col("name") == "error", "error").otherwise("write"))


@query("outlier_filter", f"""WITH s AS (SELECT name, avg(duration) AS m, stddev_pop(duration) AS d FROM {S} GROUP BY name) SELECT name, count(*) AS kept, round(sum(duration), 4) AS total FROM {S} JOIN s USING (name) WHERE abs(duration - m) <= 3 * d GROUP BY name""")
def outlier_filter(spark, root):
    return telemetry.without_outliers(spans(spark, root), "name").groupBy("name").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("duration"), 4).alias("total"))


@query("error_patterns", f"SELECT user_id, json_extract_string(attributes, '$.k') AS code, count(*) AS errors, round(count(*)::DOUBLE / (SELECT count(*) FROM {S}), 8) AS rate FROM {S} WHERE name = 'error' GROUP BY ALL")
def error_patterns(spark, root):
    return telemetry.error_patterns(spans(spark, root), F.col("name") == "error", ["user_id", F.get_json_object("attributes", "$.k").alias("code")])


@query("token_usage", f"SELECT name, round(sum(coalesce(try_cast(json_extract_string(attributes, '$.k') AS DOUBLE), 0)), 6) AS tokens, round(sum(coalesce(try_cast(json_extract_string(attributes, '$.missing') AS DOUBLE), 0)), 6) AS missing FROM {S} GROUP BY name")
def token_usage(spark, root):
    n = telemetry.number_or_zero
    return spans(spark, root).groupBy("name").agg(rounded(F.sum(n(F.col("attributes"), "$.k"))).alias("tokens"), rounded(F.sum(n(F.col("attributes"), "$.missing"))).alias("missing"))


@query("query_type_ratio", "SELECT suite, count(*) AS n, round(avg(CASE WHEN regexp_matches(text, '[a-z]_[a-z]|[a-z][A-Z]') THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS symbol_share, round(avg(CASE WHEN regexp_matches(lower(text), '^(how|what|why|when|where|which|find)\\b') THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS semantic_share FROM eval_item GROUP BY suite")
def query_type_ratio(spark, root):
    share = lambda c: rounded(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return table(spark, root, "eval_item").groupBy("suite").agg(F.count(F.lit(1)).alias("n"), share(F.col("text").rlike("[a-z]_[a-z]|[a-z][A-Z]")).alias("symbol_share"), share(F.lower("text").rlike(r"^(how|what|why|when|where|which|find)\b")).alias("semantic_share"))


VARIANT = "(('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 2)"


@query("ab_assignment", f"SELECT {VARIANT}::BIGINT AS variant, count(DISTINCT user_id) AS users, count(*) AS runs FROM events GROUP BY 1")
def ab_assignment(spark, root):
    e = table(spark, root, "events")
    return e.groupBy(metrics.variant(F.col("user_id").cast("string"), 2).alias("variant")).agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("runs"))


@query("ab_outcome", f"""WITH r AS (SELECT {VARIANT}::BIGINT AS variant, event_type <> 'error' AS ok, value FROM events), p AS (SELECT variant, count(*) AS runs, avg(ok::INT::DOUBLE) AS s, avg(value) AS l FROM r GROUP BY variant),
 w AS (SELECT *, row_number() OVER (ORDER BY s DESC, variant) AS f, lead(s) OVER (ORDER BY s DESC, variant) AS n, min(runs) OVER () AS least FROM p)
SELECT variant, runs, round(s, 6) AS success_rate, round(l, 6) AS avg_latency, coalesce(f = 1 AND s - n > 0.05 AND least >= 50, false) AS winner FROM w""")
def ab_outcome(spark, root):
    runs = table(spark, root, "events").select(metrics.variant(F.col("user_id").cast("string"), 2).alias("variant"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("latency"))
    return metrics.experiment_outcome(runs.withColumn("success", F.col("success").cast("int")))


_T_SQL = "CASE " + " ".join(f"WHEN n - 1 <= {df} THEN {t}" for df, t in metrics.T_95.items()) + " ELSE 1.96 END::DOUBLE"


@query("mean_interval", f"""WITH s AS (SELECT user_id, event_type, count(value) AS n, avg(value) AS m, stddev_samp(value) AS d FROM events GROUP BY ALL)
SELECT user_id, event_type, n, round(m, 6) AS mean, round(m - {_T_SQL} * d / sqrt(n), 6) AS low, round(m + {_T_SQL} * d / sqrt(n), 6) AS high FROM s""")
def mean_interval(spark, root):
    return metrics.mean_interval(table(spark, root, "events"), ["user_id", "event_type"], "value")


@query("knob_significance", f"""WITH s AS (SELECT event_type, {VARIANT} AS v, count(value) AS n, avg(value) AS m, stddev_samp(value) AS d FROM events GROUP BY ALL),
 i AS (SELECT *, m - {_T_SQL} * d / sqrt(n) AS lo, m + {_T_SQL} * d / sqrt(n) AS hi FROM s)
SELECT a.event_type, round(round(b.m, 6) - round(a.m, 6), 6) AS effect, round(a.hi, 6) < round(b.lo, 6) OR round(b.hi, 6) < round(a.lo, 6) AS significant FROM i a JOIN i b ON a.event_type = b.event_type AND a.v = 0 AND b.v = 1""")
def knob_significance(spark, root):
    runs = table(spark, root, "events").select("event_type", metrics.variant(F.col("user_id").cast("string"), 2).alias("variant"), "value")
    return metrics.significance(runs, ["event_type"], "variant", "value")


@query("report_deltas", """WITH m AS (SELECT event_type, avg(CASE WHEN hour(ts) < 12 THEN value END) AS a, avg(CASE WHEN hour(ts) >= 12 THEN value END) AS b FROM events GROUP BY event_type)
SELECT event_type, round(b - a, 6) AS delta, CASE WHEN round(b - a, 6) > 0.05 * a THEN 'better' WHEN round(b - a, 6) < -0.05 * a THEN 'worse' ELSE 'same' END AS verdict FROM m""")
def report_deltas(spark, root):
    """Two reports, of mornings and afternoons, compared metric by metric."""
    e = table(spark, root, "events")
    half = lambda c: e.where(c).groupBy("event_type").agg(F.avg("value").alias("value"))
    return metrics.report_deltas(half(F.hour("ts") < 12), half(F.hour("ts") >= 12), "event_type", "value")


@query("call_metrics", """WITH d AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY ts, event_id) AS r FROM events)
SELECT user_id, count(*) AS calls, sum(CASE WHEN r > 1 THEN 1 ELSE 0 END)::BIGINT AS repeated, round(avg(value), 9) AS mean FROM d GROUP BY user_id""")
def call_metrics(spark, root):
    """Calls of a session, and how many repeat an earlier one with the same arguments."""
    e = table(spark, root, "events")
    per = e.groupBy("user_id", "event_type", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return per.groupBy("user_id").agg(F.sum("n").alias("calls"), F.sum(F.col("n") - 1).alias("repeated"), rounded(F.sum("s") / F.sum("n"), 9).alias("mean"))


@query("variant_statistics", f"""SELECT {VARIANT}::BIGINT AS variant, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS error_rate
 FROM events GROUP BY 1""")
def variant_statistics(spark, root):
    e = table(spark, root, "events")
    failed = F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)
    return e.groupBy(metrics.variant(F.col("user_id").cast("string"), 2).alias("variant")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("value")).alias("mean"), rounded(F.stddev_pop("value")).alias("deviation"), rounded(F.avg(failed)).alias("error_rate"))


@query("usage_cube", "SELECT event_type, (user_id % 3) AS part, count(*) AS n FROM events GROUP BY CUBE (event_type, (user_id % 3))")
def usage_cube(spark, root):
    return table(spark, root, "events").withColumn("part", F.col("user_id") % 3).cube("event_type", "part").agg(F.count(F.lit(1)).alias("n"))


@query("metric_summary", "SELECT metric, round(avg(v), 4) AS mean, round(min(v), 4) AS least, round(max(v), 4) AS most, round(stddev_samp(v), 4) AS deviation FROM (SELECT 'quantity' AS metric, l_quantity AS v FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', l_tax FROM lineitem) GROUP BY metric")
def metric_summary(spark, root):
    long = table(spark, root, "lineitem").select(F.expr("stack(3, 'quantity', l_quantity, 'discount', l_discount, 'tax', l_tax) as (metric, v)"))
    return long.groupBy("metric").agg(*[F.round(f("v"), 4).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "most"), (F.stddev_samp, "deviation"))])


@query("effect_size", f"""WITH p AS (SELECT event_type, avg(CASE WHEN {VARIANT} = 0 THEN value END) AS a, avg(CASE WHEN {VARIANT} = 1 THEN value END) AS b, var_samp(CASE WHEN {VARIANT} = 0 THEN value END) AS va, var_samp(CASE WHEN {VARIANT} = 1 THEN value END) AS vb FROM events GROUP BY event_type)
SELECT event_type, round((a - b) / sqrt((va + vb) / 2), 6) AS cohen_d FROM p""")
def effect_size(spark, root):
    v = metrics.variant(F.col("user_id").cast("string"), 2)
    a, b = F.when(v == 0, F.col("value")), F.when(v == 1, F.col("value"))
    p = table(spark, root, "events").groupBy("event_type").agg(F.avg(a).alias("a"), F.avg(b).alias("b"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    return p.select("event_type", rounded((F.col("a") - F.col("b")) / F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("cohen_d"))


@query("matrix_comparison", f"""WITH p AS (SELECT name, user_id % 5 AS config, avg(duration) AS v FROM {S} GROUP BY ALL), b AS (SELECT name, arg_max(config, v) AS best, arg_min(config, v) AS worst, max(v) AS hi, min(v) AS lo FROM p GROUP BY name)
SELECT name, best, worst, round(hi - lo, 6) AS delta, round((hi - lo) / lo * 100, 4) AS improvement FROM b""")
def matrix_comparison(spark, root):
    p = spans(spark, root).groupBy("name", (F.col("user_id") % 5).alias("config")).agg(F.avg("duration").alias("v"))
    b = p.groupBy("name").agg(F.max_by("config", "v").alias("best"), F.min_by("config", "v").alias("worst"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    return b.select("name", "best", "worst", rounded(F.col("hi") - F.col("lo")).alias("delta"), F.round((F.col("hi") - F.col("lo")) / F.col("lo") * 100, 4).alias("improvement"))


@query("usage_rollup", "SELECT event_type, (user_id % 3) AS part, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ROLLUP (event_type, (user_id % 3))")
def usage_rollup(spark, root):
    e = table(spark, root, "events").withColumn("part", F.col("user_id") % 3)
    return e.rollup("event_type", "part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("asof_previous_error", """WITH m AS (SELECT event_id, user_id, max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM events WHERE user_id IS NOT NULL)
SELECT event_id, e AS error_id FROM m""")
def asof_previous_error(spark, root):
    """Left as-of join: the last error before each event of a user, null without one, in time order (ids rise with time)."""
    e = table(spark, root, "events").where("user_id is not null")
    return joins.last_before(e, "user_id", "ts", "event_id", F.col("event_type") == "error").select("event_id", F.col("last").alias("error_id"))


@query("spans_with_nations", "SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def spans_with_nations(spark, root):
    """Equi-joins of every size: the planner picks broadcast or sort-merge; the sums are taken before the small joins."""
    per = table(spark, root, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("t"))
    j = per.join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


def _stream(spark, root):
    return feeds.read_events(spark, root, "events.parquet", EVENTS_SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))


def _as_text(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in columns})


@query("stream_windows", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total
 FROM events GROUP BY ALL""")
def stream_windows(spark, root):
    return _as_text(feeds.drain_all(feeds.windowed(_stream(spark, root)), ["start", "event_type"]), "start")


@query("stream_sliding", """SELECT strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL '15 minutes', ts) - to_minutes(15 * i) AS s
 FROM events, (SELECT unnest([0, 1, 2, 3]) AS i)) GROUP BY ALL""")
def stream_sliding(spark, root):
    return _as_text(feeds.drain_all(feeds.sliding(_stream(spark, root)), ["start", "event_type"]), "start")


@query("stream_debounce", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '10 minutes' THEN 0 ELSE 1 END AS b FROM events WHERE user_id IS NOT NULL),
 s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, count(*) AS changes, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last FROM s GROUP BY user_id, n""")
def stream_debounce(spark, root):
    """Bursts of a user, those still open at the end too: the closed ones of the stream and, of what lies past its watermark, the rest."""
    return _as_text(feeds.bursts(_stream(spark, root).where("user_id is not null"), table(spark, root, "events").where("user_id is not null"), "user_id"), "first", "last")


@query("stream_first_seen", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, value FROM events) GROUP BY ALL")
def stream_first_seen(spark, root):
    """Equal requests within 60 days, more than the feed spans, count once."""
    return feeds.drain(feeds.first_seen(_stream(spark, root), ["user_id", "event_type", "value"], "60 days").select("user_id", "event_type")).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_requests", """WITH RECURSIVE f AS (SELECT event_type, epoch_us(ts) AS t, event_id FROM events), s AS (SELECT event_type, min(t) AS t FROM f GROUP BY event_type
 UNION ALL SELECT s.event_type, (SELECT min(f.t) FROM f WHERE f.event_type = s.event_type AND f.t >= s.t + 3600000000) FROM s WHERE s.t IS NOT NULL)
SELECT s.event_type, min(f.event_id) AS event_id FROM s JOIN f ON f.event_type = s.event_type AND f.t = s.t GROUP BY s.event_type, s.t""")
def distinct_requests(spark, root):
    """Of each event type the first of every period of an hour that begins with it."""
    e = table(spark, root, "events").select("event_id", "event_type", "ts")
    return feeds.distinct_requests(e, ["event_type"], 3600).select("event_type", "event_id")


@query("change_actions", """WITH e AS (SELECT 'p' || user_id AS path, CASE event_type WHEN 'error' THEN 'deleted' ELSE 'modified' END AS event, md5((event_id % 3)::VARCHAR) AS h, ts FROM events WHERE event_id % 7 <> 0),
 l AS (SELECT path, arg_max({'event': event, 'h': h}, (ts, event)) AS v FROM e GROUP BY path), k AS (SELECT 'p' || user_id AS path, max(md5((user_id % 3)::VARCHAR)) AS kh FROM events WHERE user_id % 2 = 0 GROUP BY 1)
SELECT l.path, CASE WHEN v.event = 'deleted' THEN (CASE WHEN kh IS NOT NULL THEN 'delete' ELSE 'skip' END) WHEN kh = v.h THEN 'skip' WHEN kh IS NOT NULL THEN 'smart' ELSE 'full' END AS action FROM l LEFT JOIN k ON l.path = k.path""")
def change_actions(spark, root):
    """What a batch of change events calls for, over paths of which half are known."""
    e = table(spark, root, "events")
    path = F.concat(F.lit("p"), F.col("user_id").cast("string"))
    hashed = lambda c: F.md5((F.col(c) % 3).cast("string"))
    changes = e.where("event_id % 7 <> 0").select(path.alias("path"), F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("event"), hashed("event_id").alias("file_hash"), "ts")
    return feeds.apply_changes(e.where("user_id % 2 = 0").select(path.alias("path"), hashed("user_id").alias("file_hash")), changes)
