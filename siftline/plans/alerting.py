"""Queries for alerts on metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.plans.registry import query
from siftline.sources.tables import table
from siftline.streaming import alerts
from siftline.streaming.alerts import Rule


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements of a metric for each type."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("ts").alias("at"), "event_id", "value")


#: One rule of each kind on a metric, and a threshold on another.
ALERT_RULES = [
    Rule("high", "error", "threshold", "greater_than", 120.0),
    Rule("odd", "error", "anomaly", value=1.75),
    Rule("rising", "error", "trend", "greater_than", 0.4, rows=40),
    Rule("odd and high", "error", "composite", of=("odd", "high")),
    Rule("low", "view", "threshold", "less_than", 1.0),
    Rule("falling", "view", "trend", "less_than", -0.5, rows=40, least=20),
]
ALERTS_SQL = """m AS (SELECT event_type AS metric, event_id, ts, CAST(round(value * 10000) AS HUGEINT) AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS j
    FROM events WHERE event_type IN ('error', 'view') AND value IS NOT NULL),
  w AS (SELECT *, count(*) OVER b AS n, sum(v) OVER b AS s, sum(v * v) OVER b AS q, count(*) OVER h AS k, sum(v) OVER h AS t, sum(v * j) OVER h - min(j) OVER h * sum(v) OVER h AS x FROM m
    WINDOW b AS (PARTITION BY metric ORDER BY j ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING), h AS (PARTITION BY metric ORDER BY j ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
  f AS (SELECT *, metric = 'error' AND v > 1200000 AS high, metric = 'error' AND n >= 10 AND (n * v - s) * (n * v - s) * 10000 > (n * q - s * s) * 30625 AS odd,
    12 * k * x - 6 * k * (k - 1) * t AS rise, k * k * (k - 1) * (k + 1) AS level FROM w),
  r AS (SELECT metric, event_id, ts, j, rule, broken FROM (SELECT metric, event_id, ts, j, unnest(CASE metric WHEN 'error' THEN ['high', 'odd', 'rising', 'odd and high'] ELSE ['low', 'falling'] END) AS rule,
    unnest(CASE metric WHEN 'error' THEN [high, odd, k >= 10 AND rise > level * 4000, high AND odd] ELSE [v < 10000, k >= 20 AND rise < level * -5000] END) AS broken FROM f))"""


@query(f"WITH {ALERTS_SQL} SELECT metric, rule, event_id FROM r WHERE broken")
def alert_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.breaches(measurements(spark, sf_dir), ALERT_RULES).select("metric", "rule", "event_id")


@query(
    f"""WITH {ALERTS_SQL} SELECT metric, rule, event_id, CASE WHEN broken THEN 'active' ELSE 'resolved' END AS status
    FROM (SELECT *, lag(broken, 1, false) OVER (PARTITION BY metric, rule ORDER BY j) AS before FROM r) WHERE broken <> before"""
)
def alert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.changes(measurements(spark, sf_dir), ALERT_RULES).select("metric", "rule", "event_id", "status")
