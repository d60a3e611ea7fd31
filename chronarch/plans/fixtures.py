"""Versioned tables derived from the star schema: what was reported of each day, and when."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronarch.archive import Archive, as_archive
from chronarch.sources.tables import table

KEYS = ("geo_value", "grp")

#: SQL of the same tables: arch (running sums by version), del (with deletions), other (reported with other delays).
TABLES = """
WITH RECURSIVE rep AS (
  SELECT event_type AS geo_value, user_id % 20 AS grp, CAST(ts AS DATE) AS time_value, CAST(ts AS DATE) + CAST(event_id % 5 AS INTEGER) AS version,
    CAST(ts AS DATE) + CAST(event_id % 3 * 2 AS INTEGER) AS version2, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
upd AS (SELECT geo_value, grp, time_value, version, sum(cents) AS cents, count(*) AS k FROM rep GROUP BY ALL),
arch AS (
  SELECT geo_value, grp, time_value, version, CAST(sum(cents) OVER w AS BIGINT) AS value, CAST(sum(k) OVER w AS BIGINT) AS n, cents FROM upd
  WINDOW w AS (PARTITION BY geo_value, grp, time_value ORDER BY version ROWS UNBOUNDED PRECEDING)),
del AS (SELECT geo_value, grp, time_value, version, CASE WHEN cents % 17 <> 0 THEN value END AS value, CASE WHEN cents % 17 <> 0 THEN n END AS n FROM arch),
upd2 AS (SELECT geo_value, grp, time_value, version2 AS version, count(*) AS k FROM rep GROUP BY ALL),
other AS (SELECT geo_value, grp, time_value, version, CAST(sum(k) OVER (PARTITION BY geo_value, grp, time_value ORDER BY version ROWS UNBOUNDED PRECEDING) AS BIGINT) AS reports FROM upd2),
latest AS (SELECT geo_value, grp, time_value, arg_max(value, version) AS value, arg_max(n, version) AS n FROM arch GROUP BY ALL),
valid AS (SELECT *, lead(version) OVER (PARTITION BY geo_value, grp, time_value ORDER BY version) AS until FROM del),
versions AS (SELECT DISTINCT version AS v FROM del),
each AS MATERIALIZED (SELECT geo_value, grp, time_value, v AS version, value, n FROM valid JOIN versions ON v >= version AND (until IS NULL OR v < until))
"""


def _reports(spark: SparkSession, sf_dir: str, modulus: int, stretch: int) -> DataFrame:
    day = F.to_date("ts")
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("geo_value"), (F.col("user_id") % 20).alias("grp"), day.alias("time_value"),
        F.date_add(day, (F.col("event_id") % modulus * stretch).cast("int")).alias("version"), F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def reports(spark: SparkSession, sf_dir: str, deletions: bool = False) -> Archive:
    """Cents and numbers of events by type, user group and day, reported up to four days late."""
    upd = _reports(spark, sf_dir, 5, 1).groupBy(*KEYS, "time_value", "version").agg(F.sum("cents").alias("cents"), F.count("*").alias("k"))
    w = Window.partitionBy(*KEYS, "time_value").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    there = F.col("cents") % 17 != 0 if deletions else F.lit(True)
    df = upd.withColumns({"value": F.sum("cents").over(w), "n": F.sum("k").over(w)})
    df = df.select(*KEYS, "time_value", "version", *[F.when(there, F.col(c)).alias(c) for c in ("value", "n")])
    return as_archive(df, KEYS, compact=False, check=False)


def other_reports(spark: SparkSession, sf_dir: str) -> Archive:
    """Numbers of events, reported with other delays."""
    upd = _reports(spark, sf_dir, 3, 2).groupBy(*KEYS, "time_value", "version").agg(F.count("*").alias("k"))
    w = Window.partitionBy(*KEYS, "time_value").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    return as_archive(upd.select(*KEYS, "time_value", "version", F.sum("k").over(w).alias("reports")), KEYS, compact=False, check=False)
