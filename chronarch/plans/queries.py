"""One query for each operator, over whole tables, with its SQL."""

from __future__ import annotations

import uuid
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from chronarch.archive import Archive, as_archive, duplicate_keys
from chronarch.functions.steps import week_end
from chronarch.operators import changes, grouping, joining, nowcast, shaping, sliding, travel
from chronarch.operators.compaction import compactify
from chronarch.plans.fixtures import KEYS, TABLES, other_reports, reports
from chronarch.plans.registry import QUERIES, SQL, query
from chronarch.sources import snapshots, tables
from chronarch.sources.tables import read_archive, recent_versions, shared_folder, table, write_archive
from chronarch.streaming.slides import slide_stream, state_store
from chronarch.streaming.updates import compact_stream, windowed_counts

__all__ = ["QUERIES", "SQL"]

EARLY, LATE = date(2024, 1, 10), date(2024, 1, 15)
EKT = [*KEYS, "time_value"]
_COMPACT = "SELECT geo_value, grp, time_value, version, {cols} FROM (SELECT *, row_number() OVER w AS rn, {lags} FROM {src} WINDOW w AS (PARTITION BY geo_value, grp, time_value ORDER BY version)) WHERE rn = 1 OR {changed}"
_CHANGED = "value IS DISTINCT FROM pv OR n IS DISTINCT FROM pn"


def _compact_sql(src: str, changed: str = _CHANGED, cols: str = "value, n", lags: str = "lag(value) OVER w AS pv, lag(n) OVER w AS pn") -> str:
    return _COMPACT.format(src=src, changed=changed, cols=cols, lags=lags)


# Compaction


@query(TABLES + _compact_sql("del"))
def compactify_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compactify(reports(spark, sf_dir, True).df, EKT)


@query(TABLES + _compact_sql("del", "NOT ((value IS NULL AND pv IS NULL OR coalesce(abs(value - pv) <= 3000, false)) AND (n IS NULL AND pn IS NULL OR coalesce(abs(n - pn) <= 3000, false)))"))
def compactify_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compactify(reports(spark, sf_dir, True).df, EKT, tol=3000)


# Time travel


def _as_of_sql(v: str, src: str = "del") -> str:
    return f"SELECT geo_value, grp, time_value, value, n FROM {src} WHERE version <= DATE '{v}' QUALIFY row_number() OVER (PARTITION BY geo_value, grp, time_value ORDER BY version DESC) = 1"


@query(TABLES + _as_of_sql("2024-01-15"))
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.as_of(reports(spark, sf_dir, True), LATE).df


@query(TABLES + _as_of_sql("2099-01-01"))
def as_of_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.as_of_latest(reports(spark, sf_dir, True)).df


@query(TABLES + "SELECT * FROM each")
def as_of_all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.as_of_each(reports(spark, sf_dir, True))


@query(TABLES + "SELECT * FROM del WHERE version <= DATE '2024-01-15'")
def truncate_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.truncate(reports(spark, sf_dir, True), LATE).df


@query(TABLES + "SELECT * FROM del WHERE geo_value = 'click' AND grp <> 3 AND version <= DATE '2024-01-15'")
def archive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir, True).where("geo_value = 'click' AND grp <> 3").where(F.col("version") <= LATE).df


@query(TABLES + "SELECT * FROM del WHERE version <= time_value + 2")
def version_range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_versions(reports(spark, sf_dir, True), 2)


@query(TABLES + "SELECT geo_value, grp, version, min(time_value) AS first_time, max(time_value) AS last_time FROM del GROUP BY ALL")
def update_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.update_extent(reports(spark, sf_dir, True))


@query(
    TABLES
    + """, keyed AS (SELECT geo_value, grp, time_value, version FROM arch UNION SELECT geo_value, grp, time_value, version FROM other)
SELECT k.geo_value, k.grp, k.time_value, k.version, last_value(a.value IGNORE NULLS) OVER w AS value, last_value(a.n IGNORE NULLS) OVER w AS n, last_value(o.reports IGNORE NULLS) OVER w AS reports
FROM keyed k LEFT JOIN arch a USING (geo_value, grp, time_value, version) LEFT JOIN other o USING (geo_value, grp, time_value, version)
WINDOW w AS (PARTITION BY k.geo_value, k.grp, k.time_value ORDER BY k.version ROWS UNBOUNDED PRECEDING)"""
)
def merge_locf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.merge_locf(reports(spark, sf_dir), other_reports(spark, sf_dir)).df


def _snapshot_total(version: date, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"rows": [len(rows)], "total": [int(rows["value"].fillna(0).sum())]})


@query(TABLES + "SELECT version, geo_value, count(*) AS rows, CAST(sum(coalesce(value, 0)) AS BIGINT) AS total FROM each WHERE time_value >= version - 6 GROUP BY ALL")
def epix_slide_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.slide_versions(reports(spark, sf_dir, True), _snapshot_total, "version date, geo_value string, rows long, total long", before=6, by=["geo_value"])


def _history_total(version: date, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"rows": [len(rows)], "updates": [rows["version"].nunique()]})


@query(TABLES + "SELECT v AS version, geo_value, count(*) AS rows, count(DISTINCT version) AS updates FROM del JOIN versions ON version <= v WHERE time_value >= v - 6 GROUP BY ALL")
def epix_slide_all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.slide_versions(reports(spark, sf_dir, True), _history_total, "version date, geo_value string, rows long, updates long", before=6, by=["geo_value"], all_versions=True)


@query(TABLES + _compact_sql("del", "value IS DISTINCT FROM pv", "", "lag(value) OVER w AS pv").replace("version,  FROM", "version FROM"))
def diff_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.change_keys(reports(spark, sf_dir, True), ["value"])


@query(TABLES + "SELECT geo_value, grp, time_value, version FROM del WHERE value IS NOT NULL")
def confirmation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.confirmation_keys(reports(spark, sf_dir, True), "value")


@query(
    TABLES
    + f""", snap AS ({_as_of_sql("2024-01-15")}), keyed AS ({_compact_sql("del", "value IS DISTINCT FROM pv", "1 AS one", "lag(value) OVER w AS pv")}),
newest AS (SELECT geo_value, grp, time_value, max(version) AS key_version FROM keyed WHERE version <= DATE '2024-01-15' GROUP BY ALL)
SELECT s.*, key_version FROM snap s LEFT JOIN newest USING (geo_value, grp, time_value)"""
)
def corresponding_diff_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reports(spark, sf_dir, True)
    return travel.corresponding_versions(travel.as_of(a, LATE).df, travel.change_keys(a, ["value"]), a, LATE)


def _lookup_sql(offset: int, lag: int, name: str, tolerance: str = "TRUE") -> str:
    return (
        TABLES
        + f""", rows AS (SELECT DISTINCT geo_value, grp, time_value FROM del),
found AS (SELECT r.geo_value, r.grp, r.time_value, d.version, d.value FROM rows r JOIN del d ON d.geo_value = r.geo_value AND d.grp = r.grp AND d.time_value = r.time_value + {offset} AND d.version <= r.time_value + {lag}
  QUALIFY row_number() OVER (PARTITION BY r.geo_value, r.grp, r.time_value ORDER BY d.version DESC) = 1)
SELECT r.*, CASE WHEN {tolerance} THEN f.value END AS {name} FROM rows r LEFT JOIN found f USING (geo_value, grp, time_value)"""
    )


@query(_lookup_sql(-2, 1, "value_back", "f.version + 2 >= r.time_value + 1"))
def asof_lookup_tvoffset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reports(spark, sf_dir, True)
    return travel.lookup_offset(a, a.df.select(*EKT).distinct(), "value", -2, 1, "value_back", tolerance=2)


@query(_lookup_sql(0, 2, "value_lag2"))
def asof_lookup_version_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reports(spark, sf_dir, True)
    return travel.lookup_version_lag(a, a.df.select(*EKT).distinct(), "value", 2)


@query(TABLES + "SELECT geo_value, grp, v AS anchor_version, time_value AS target_time, value AS target FROM versions JOIN (" + _as_of_sql("2099-01-01") + ") ON time_value = v - 3")
def evaluation_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reports(spark, sf_dir, True)
    return travel.evaluation_data(a, "value", -3, a.df.select("version"))


# Differences and folds

_PAIR = f", one AS ({_as_of_sql('2024-01-10')}), two AS (SELECT * FROM ({_as_of_sql('2024-01-15')}) WHERE time_value > DATE '2024-01-02')"
_UPDATE = """SELECT t.* FROM two t LEFT JOIN one o USING (geo_value, grp, time_value) WHERE o.geo_value IS NULL OR t.value IS DISTINCT FROM o.value OR t.n IS DISTINCT FROM o.n"""
_DELETED = "SELECT geo_value, grp, time_value, NULL AS value, NULL AS n FROM one ANTI JOIN two USING (geo_value, grp, time_value)"


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a = reports(spark, sf_dir, True)
    return travel.as_of(a, EARLY).df, travel.as_of(a, LATE).df.where(F.col("time_value") > date(2024, 1, 2))


@query(TABLES + _PAIR + f" {_UPDATE} UNION ALL {_DELETED}")
def snapshot_diff_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff(*_pair(spark, sf_dir), EKT)


@query(TABLES + _PAIR + _UPDATE)
def snapshot_diff_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.diff(*_pair(spark, sf_dir), EKT, "update")


@query(TABLES + _PAIR + f", made AS ({_UPDATE} UNION ALL {_DELETED}) SELECT * FROM made UNION ALL SELECT * FROM one ANTI JOIN made USING (geo_value, grp, time_value)")
def patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _pair(spark, sf_dir)
    return changes.patch(one, changes.diff(one, two, EKT), EKT)


_SNAPSHOTS = """, snaps AS (SELECT * FROM each WHERE value IS NOT NULL), ord AS (SELECT v, lag(v) OVER (ORDER BY v) AS before FROM versions)
SELECT s.geo_value, s.grp, s.time_value, s.version, s.value, s.n FROM snaps s JOIN ord o ON s.version = o.v
LEFT JOIN snaps p ON p.geo_value = s.geo_value AND p.grp = s.grp AND p.time_value = s.time_value AND p.version = o.before
WHERE p.geo_value IS NULL OR p.value IS DISTINCT FROM s.value OR p.n IS DISTINCT FROM s.n
UNION ALL
SELECT p.geo_value, p.grp, p.time_value, o.v, NULL, NULL FROM ord o JOIN snaps p ON p.version = o.before
LEFT JOIN snaps s ON p.geo_value = s.geo_value AND p.grp = s.grp AND p.time_value = s.time_value AND s.version = o.v WHERE s.geo_value IS NULL"""


@query(TABLES + _SNAPSHOTS)
def snapshots_to_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reports(spark, sf_dir, True)
    return changes.snapshots_to_archive(travel.as_of_each(a).where("value IS NOT NULL"), EKT, versions=a.df.select("version"))


@query(TABLES + _compact_sql("del"))
def updates_to_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.updates_to_archive(reports(spark, sf_dir, True).df, EKT)


@query(
    TABLES
    + """, per AS (SELECT geo_value, grp, version, sum(n) AS k FROM arch GROUP BY ALL),
sums AS (SELECT geo_value, grp, version, CAST(sum(k) OVER (PARTITION BY geo_value, grp ORDER BY version) AS BIGINT) AS value FROM per)
SELECT geo_value, grp, DATE '2024-01-01' AS time_value, version, value FROM sums QUALIFY value IS DISTINCT FROM lag(value) OVER (PARTITION BY geo_value, grp ORDER BY version)"""
)
def map_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(total: int, version: date, rows: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        total += int(rows["n"].sum())
        return total, pd.DataFrame({"time_value": [date(2024, 1, 1)], "value": [total]})

    schema = "geo_value string, grp long, time_value date, version date, value long"
    return changes.map_accumulate(reports(spark, sf_dir).df, f, 0, schema, list(KEYS), EKT, result="update")


@query(TABLES + "SELECT geo_value, grp, CAST(sum(n) AS BIGINT) AS accumulator FROM arch GROUP BY ALL")
def map_accumulate_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(total: int, version: date, rows: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        return total + int(rows["n"].sum()), rows

    return changes.last_accumulator(reports(spark, sf_dir).df, f, 0, list(KEYS), "long")


@query(TABLES + "SELECT geo_value, grp, CAST(count(*) AS BIGINT) AS n FROM rep GROUP BY ALL HAVING count(*) > 1")
def dup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return duplicate_keys(events.select(F.col("event_type").alias("geo_value"), (F.col("user_id") % 20).alias("grp")), list(KEYS))


# Sliding windows


def _slide_sql(expr: str, name: str, before: int | None, after: int, col: str = "value", src: str = "latest", by: str = "") -> str:
    frame = "UNBOUNDED PRECEDING" if before is None else f"{before} PRECEDING"
    full = "t - min(t) OVER w + 1" if before is None else str(before + after + 1)
    return f"SELECT *, CASE WHEN count({col}) OVER w = {full} THEN {expr} END AS {name} FROM (SELECT *, date_diff('day', DATE '1970-01-01', time_value) AS t FROM {src}) WINDOW w AS (PARTITION BY geo_value, grp{by} ORDER BY t RANGE BETWEEN {frame} AND {after} FOLLOWING)"


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return travel.as_of_latest(reports(spark, sf_dir)).df


def _slid(spark: SparkSession, sf_dir: str, *args, **how) -> DataFrame:
    return sliding.slide(_latest(spark, sf_dir), list(KEYS), *args, **how)


@query(TABLES + f"SELECT * EXCLUDE t FROM ({_slide_sql('CAST(sum(value) OVER w AS BIGINT)', 'value_7dsum', 6, 0)})")
def slide_sum_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slid(spark, sf_dir, ["value"], "sum", 7)


@query(TABLES + f"SELECT * EXCLUDE t FROM ({_slide_sql('avg(value) OVER w', 'value_7dcav', 3, 3)})")
def slide_mean_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slid(spark, sf_dir, ["value"], "mean", 7, "center")


@query(TABLES + f"SELECT * EXCLUDE t FROM ({_slide_sql('min(value) OVER w', 'value_3dlmin', 0, 2)})")
def slide_min_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slid(spark, sf_dir, ["value"], "min", 3, "left")


@query(TABLES + f"SELECT * EXCLUDE t FROM ({_slide_sql('max(value) OVER w', 'value_5dmax', 4, 0)})")
def slide_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slid(spark, sf_dir, ["value"], "max", 5)


@query(TABLES + f"SELECT * EXCLUDE t FROM ({_slide_sql('product(n) OVER w', 'n_2dprod', 1, 0, 'n')})")
def slide_prod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slid(spark, sf_dir, ["n"], "prod", 2)


@query(TABLES + f"SELECT * EXCLUDE t FROM ({_slide_sql('CAST(sum(value) OVER w AS BIGINT)', 'value_running_sum', None, 0)})")
def slide_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slid(spark, sf_dir, ["value"], "sum", float("inf"))


@query(TABLES + f"SELECT * EXCLUDE t FROM ({_slide_sql('CAST(max(value) OVER w - min(value) OVER w AS DOUBLE)', 'spread', 4, 0)})")
def slide_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.slide_apply(_latest(spark, sf_dir), list(KEYS), "value", lambda x: max(x) - min(x), 5, name="spread")


_WEEKS = """, weekly AS (SELECT geo_value, grp, CAST(time_value + CAST((6 - dayofweek(time_value)) % 7 AS INTEGER) AS DATE) AS time_value, CAST(sum(n) AS BIGINT) AS n FROM latest GROUP BY ALL)"""


@query(TABLES + _WEEKS + " SELECT *, CASE WHEN count(n) OVER w = 2 THEN CAST(sum(n) OVER w AS BIGINT) END AS n_2wsum FROM weekly WINDOW w AS (PARTITION BY geo_value, grp ORDER BY time_value RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)")
def weekly_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by week, told by its last day, and their sums over two weeks."""
    weeks = _latest(spark, sf_dir).groupBy(*KEYS, week_end(F.col("time_value")).alias("time_value")).agg(F.sum("n").alias("n"))
    return sliding.slide(weeks, list(KEYS), ["n"], "sum", 2, time_type="week")


@query(TABLES + _WEEKS + " SELECT geo_value, grp, v AS anchor_version, w.time_value AS target_time, n AS target FROM versions JOIN weekly w ON w.time_value = v + CAST((6 - dayofweek(v)) % 7 AS INTEGER) - 7")
def weekly_evaluation_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each version, the count of the week before the one that holds it."""
    a = reports(spark, sf_dir, True)
    weeks = _latest(spark, sf_dir).groupBy(*KEYS, week_end(F.col("time_value")).alias("time_value")).agg(F.sum("n").alias("n"))
    weekly = Archive(weeks.withColumn("version", F.col("time_value")), KEYS, "week")
    return travel.evaluation_data(weekly, "n", -1, a.df.select("version"))


_EVEN = ", flags AS (SELECT geo_value, grp, time_value, value % 2 = 0 AS even FROM latest)"


def _even(spark: SparkSession, sf_dir: str, f: str) -> DataFrame:
    flags = _latest(spark, sf_dir).select(*EKT, (F.col("value") % 2 == 0).alias("even"))
    return sliding.slide(flags, list(KEYS), ["even"], f, 4)


@query(TABLES + _EVEN + f" SELECT * EXCLUDE t FROM ({_slide_sql('bool_or(even) OVER w', 'even_4dany', 3, 0, 'even', 'flags')})")
def slide_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _even(spark, sf_dir, "any")


@query(TABLES + _EVEN + f" SELECT * EXCLUDE t FROM ({_slide_sql('bool_and(even) OVER w', 'even_4dall', 3, 0, 'even', 'flags')})")
def slide_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _even(spark, sf_dir, "all")


@query(TABLES + _EVEN + f" SELECT * EXCLUDE t FROM ({_slide_sql('avg(CAST(even AS INTEGER)) OVER w', 'even_4dprop', 3, 0, 'even', 'flags')})")
def slide_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _even(spark, sf_dir, "mean")


def _archive_slide_sql(expr: str, name: str, before: int | None, after: int) -> str:
    every = f", slid AS MATERIALIZED ({_slide_sql(expr, name, before, after, src='each', by=', version')})"
    return TABLES + every + _compact_sql("slid", f"{name} IS DISTINCT FROM pv", name, f"lag({name}) OVER w AS pv")


@query(_archive_slide_sql("CAST(sum(value) OVER w AS BIGINT)", "value_7dsum", 6, 0))
def archive_slide_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.archive_slide(reports(spark, sf_dir, True), "value", "sum", 7).df


@query(_archive_slide_sql("avg(value) OVER w", "value_7dcav", 3, 3))
def archive_slide_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.archive_slide(reports(spark, sf_dir, True), "value", "mean", 7, "center").df


@query(_archive_slide_sql("max(value) OVER w", "value_7dlmax", 0, 6))
def archive_slide_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.archive_slide(reports(spark, sf_dir, True), "value", "max", 7, "left").df


@query(_archive_slide_sql("max(value) OVER w", "value_20dmax", 19, 0))
def archive_slide_wide_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.archive_slide(reports(spark, sf_dir, True), "value", "max", 20).df


@query(_archive_slide_sql("CAST(sum(value) OVER w AS BIGINT)", "value_running_sum", None, 0))
def archive_slide_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.archive_slide(reports(spark, sf_dir, True), "value", "sum", float("inf")).df


@query(_archive_slide_sql("CAST(sum(value) OVER w AS BIGINT) / count(value) OVER w", "value_running_av", None, 0))
def archive_slide_running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.archive_slide(reports(spark, sf_dir, True), "value", "mean", float("inf")).df


_BOTH = "CASE WHEN count(value) OVER w = 7 THEN CAST(sum(value) OVER w AS BIGINT) END AS value_7dsum, CASE WHEN count(n) OVER w = 7 THEN CAST(sum(n) OVER w AS BIGINT) END AS n_7dsum"


@query(
    TABLES
    + f", slid AS MATERIALIZED (SELECT geo_value, grp, time_value, version, {_BOTH} FROM (SELECT *, date_diff('day', DATE '1970-01-01', time_value) AS t FROM each) WINDOW w AS (PARTITION BY geo_value, grp, version ORDER BY t RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))"
    + _compact_sql("slid", "value_7dsum IS DISTINCT FROM pv OR n_7dsum IS DISTINCT FROM pn", "value_7dsum, n_7dsum", "lag(value_7dsum) OVER w AS pv, lag(n_7dsum) OVER w AS pn")
)
def archive_slide_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several columns in one pass, grouped by all keys."""
    return sliding.archive_slide(reports(spark, sf_dir, True), ["value", "n"], "sum", 7, groups=list(KEYS)).df


@query(_archive_slide_sql("CAST(max(value) OVER w - min(value) OVER w AS DOUBLE)", "spread", 4, 0))
def archive_slide_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sliding.archive_slide_apply(reports(spark, sf_dir, True), "value", lambda x: max(x) - min(x), 5, name="spread").df


# Joins


@query(TABLES + ", spans AS (SELECT geo_value, grp, min(time_value) AS low, max(time_value) AS high FROM del WHERE version = DATE '2024-01-15' GROUP BY ALL) SELECT d.* FROM del d SEMI JOIN spans s ON d.geo_value = s.geo_value AND d.grp = s.grp AND d.time_value BETWEEN low AND high")
def semi_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reports(spark, sf_dir, True)
    spans = a.df.where(F.col("version") == LATE).groupBy(*KEYS).agg(F.min("time_value").alias("low"), F.max("time_value").alias("high"))
    return joining.semi_join_range(a.df, spans, list(KEYS), "time_value", "low", "high")


@query(TABLES + _PAIR + " SELECT t.* FROM two t WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.geo_value = t.geo_value AND o.grp = t.grp AND o.time_value = t.time_value AND o.value IS NOT DISTINCT FROM t.value AND o.n IS NOT DISTINCT FROM t.n)")
def anti_join_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _pair(spark, sf_dir)
    return joining.anti_join(two, one, two.columns)


@query(TABLES + ", spans AS (SELECT geo_value, grp, version, min(time_value) AS first_time, max(time_value) AS last_time FROM del GROUP BY ALL), weeks AS (SELECT DISTINCT geo_value, date_trunc('week', time_value)::DATE AS w_start, date_trunc('week', time_value)::DATE + 6 AS w_end FROM del) SELECT s.*, w_start, w_end FROM spans s JOIN weeks w ON s.geo_value = w.geo_value AND first_time >= w_start AND last_time <= w_end")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = reports(spark, sf_dir, True)
    monday = F.date_trunc("week", F.col("time_value")).cast("date")
    weeks = a.df.select("geo_value", monday.alias("w_start"), F.date_add(monday, 6).alias("w_end")).distinct()
    return joining.interval_join(travel.update_extent(a), weeks, ["geo_value"], "first_time", "last_time", "w_start", "w_end")


@query(TABLES + ", spans AS (SELECT geo_value, grp, version, min(time_value) AS first_time, max(time_value) AS last_time FROM del GROUP BY ALL), weeks AS (SELECT DISTINCT date_trunc('week', time_value)::DATE AS w_start, date_trunc('week', time_value)::DATE + 6 AS w_end FROM del) SELECT s.*, w_start, w_end FROM spans s JOIN weeks w ON first_time >= w_start AND last_time <= w_end")
def interval_join_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals within intervals, without a key."""
    a = reports(spark, sf_dir, True)
    monday = F.date_trunc("week", F.col("time_value")).cast("date")
    weeks = a.df.select(monday.alias("w_start"), F.date_add(monday, 6).alias("w_end")).distinct()
    return joining.interval_join(travel.update_extent(a), weeks, [], "first_time", "last_time", "w_start", "w_end")


@query(TABLES + """, spans AS (SELECT geo_value, grp, version, min(time_value) - 2 AS first_time, max(time_value) AS last_time FROM del GROUP BY ALL)
SELECT s.*, coalesce(string_agg(l.time_value::VARCHAR || ':' || l.n::VARCHAR, ' ' ORDER BY l.time_value), '') AS known FROM spans s
LEFT JOIN latest l ON l.geo_value = s.geo_value AND l.grp = s.grp AND l.time_value BETWEEN first_time AND last_time GROUP BY ALL""")
def nest_join_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each update's reach, with what is known of its times in the end."""
    spans = travel.update_extent(reports(spark, sf_dir, True)).withColumn("first_time", F.date_sub("first_time", 2))
    out = joining.nest_join_between(spans, _latest(spark, sf_dir).drop("value"), list(KEYS), "first_time", "last_time", "time_value", "known", ["time_value"])
    return out.withColumn("known", F.array_join(F.transform("known", lambda r: F.concat_ws(":", r["time_value"].cast("string"), r["n"].cast("string"))), " "))


@query("SELECT n_nationkey, n_name, coalesce(string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey), '') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL")
def nest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    out = joining.nest_join(nation, supplier, ["n_nationkey"], "all", ["s_suppkey"])
    return out.select("n_nationkey", "n_name", F.array_join(F.transform("all.s_suppkey", lambda x: x.cast("string")), ",").alias("suppliers"))


@query(TABLES + _PAIR + " SELECT o.geo_value, o.grp, o.time_value, CASE WHEN t.geo_value IS NOT NULL THEN t.value ELSE o.value END AS value, CASE WHEN t.geo_value IS NOT NULL THEN t.n ELSE o.n END AS n FROM one o LEFT JOIN two t USING (geo_value, grp, time_value)")
def update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joining.update_join(*_pair(spark, sf_dir), EKT)


@query(TABLES + _PAIR + " SELECT * FROM two UNION ALL SELECT * FROM one ANTI JOIN two USING (geo_value, grp, time_value)")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joining.upsert(*_pair(spark, sf_dir), EKT)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ANTI JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def anti_join_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(rich, "o_custkey", "left_anti")


# Nowcasting

_OFFSETS, _SIZES = [0, -7], [1, 3]
TEST_TIME, TEST_VERSION = date(2024, 1, 20), date(2024, 1, 20)
_SPECS = """, specs(predictor, feature, low, high) AS (VALUES ('value', 'value_p0_w1', 0, 0), ('value', 'value_p0_w3', -2, 0), ('value', 'value_m7_w1', -7, -7), ('value', 'value_m7_w3', -9, -7)),
keyed AS (SELECT geo_value, grp, time_value, max(version) AS v FROM arch WHERE version <= DATE '2024-01-20' GROUP BY ALL),
cells AS MATERIALIZED (SELECT geo_value, grp, predictor, feature, date_diff('day', DATE '2024-01-20', time_value) AS horizon, date_diff('day', DATE '2024-01-20', v) AS lag FROM keyed JOIN specs ON date_diff('day', DATE '2024-01-20', time_value) BETWEEN low AND high),
temps AS (SELECT geo_value, grp, predictor, feature, string_agg(horizon || ':' || lag, ' ' ORDER BY horizon, lag) AS template, count(*) AS size FROM cells GROUP BY ALL)"""


def _templates(spark: SparkSession, sf_dir: str):
    a = reports(spark, sf_dir)
    return a, nowcast.templates(a, nowcast.feature_specs(spark, ["value"], _OFFSETS, _SIZES), TEST_TIME, TEST_VERSION)


def _told(template: str):
    return F.array_join(F.transform(template, lambda c: F.concat_ws(":", c["horizon"].cast("string"), c["lag"].cast("string"))), " ")


@query(TABLES + _SPECS + " SELECT geo_value, grp, predictor, feature, template FROM temps")
def feature_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir)[1].withColumn("template", _told("template"))


@query(TABLES + _SPECS + " SELECT predictor, feature, template, string_agg(geo_value || '/' || grp, ' ' ORDER BY geo_value, grp) AS entities FROM temps GROUP BY ALL")
def task_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nowcast.tasks(_templates(spark, sf_dir)[1], list(KEYS))
    entities = F.array_join(F.transform("entities", lambda e: F.concat_ws("/", e["geo_value"], e["grp"].cast("string"))), " ")
    return out.select("predictor", "feature", _told("template").alias("template"), entities.alias("entities"))


_FEATURES = """, rows AS (SELECT DISTINCT geo_value, grp, time_value FROM arch),
found AS (SELECT r.geo_value, r.grp, r.time_value, c.feature, c.horizon, arg_max(a.value, a.version) AS x FROM rows r JOIN cells c USING (geo_value, grp)
  LEFT JOIN arch a ON a.geo_value = r.geo_value AND a.grp = r.grp AND a.time_value = r.time_value + c.horizon::INTEGER AND a.version <= r.time_value + c.lag::INTEGER GROUP BY ALL),
feats AS (SELECT geo_value, grp, time_value, f.feature, CASE WHEN count(x) = max(t.size) THEN CAST(sum(x) AS BIGINT) END AS value FROM found f JOIN temps t USING (geo_value, grp, feature) GROUP BY ALL)"""
_NAMES = ["value_p0_w1", "value_p0_w3", "value_m7_w1", "value_m7_w3"]
_WIDE = (
    """, wide AS (SELECT geo_value, grp, time_value, l.value AS target, """
    + ", ".join(f"max(f.value) FILTER (f.feature = '{n}') AS {n}" for n in _NAMES)
    + " FROM latest l JOIN feats f USING (geo_value, grp, time_value) GROUP BY ALL), training AS (SELECT * FROM wide WHERE coalesce(value_p0_w1, value_p0_w3) IS NOT NULL)"
)


def _features(spark: SparkSession, sf_dir: str):
    a, found = _templates(spark, sf_dir)
    return a, nowcast.template_features(a, a.df.select(*EKT).distinct(), found, predictors=["value"])


def _training(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, features = _features(spark, sf_dir)
    targets = travel.as_of_latest(a).df.select(*EKT, F.col("value").alias("target"))
    return nowcast.training_table(a, targets, features, _NAMES, _NAMES[:2])


@query(TABLES + _SPECS + _FEATURES + " SELECT * FROM feats")
def sum_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)[1]


@query(TABLES + _SPECS + _FEATURES + _WIDE + " SELECT * FROM training")
def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training(spark, sf_dir)


_TESTING = _FEATURES.replace("SELECT DISTINCT geo_value, grp, time_value FROM arch", "SELECT DISTINCT geo_value, grp, DATE '2024-01-20' AS time_value FROM arch").replace("arg_max(a.value, a.version) AS x", "CASE WHEN max(a.version) = any_value(r.time_value + c.lag::INTEGER) THEN arg_max(a.value, a.version) END AS x")


@query(
    TABLES + _SPECS + _TESTING
    + " SELECT r.geo_value, r.grp, r.time_value, " + ", ".join(f"max(f.value) FILTER (f.feature = '{n}') AS {n}" for n in _NAMES)
    + ", 1.0::DOUBLE AS intercept FROM rows r LEFT JOIN feats f USING (geo_value, grp, time_value) GROUP BY ALL"
)
def testing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, found = _templates(spark, sf_dir)
    return nowcast.testing_table(a, a.df, found, _NAMES, TEST_TIME, ["value"])


@query(
    TABLES
    + f""", snap AS ({_as_of_sql("2024-01-15")}), keyed AS ({_compact_sql("del", "value IS DISTINCT FROM pv", "1 AS one", "lag(value) OVER w AS pv")}),
newest AS (SELECT geo_value, grp, time_value, max(version) AS v FROM keyed WHERE version <= DATE '2024-01-15' GROUP BY ALL),
near AS (SELECT geo_value, grp, string_agg(s.time_value || ':' || v, ' ' ORDER BY s.time_value) AS tv FROM snap s JOIN newest USING (geo_value, grp, time_value) WHERE value IS NOT NULL AND s.time_value BETWEEN DATE '2024-01-14' AND DATE '2024-01-15' GROUP BY ALL)
SELECT geo_value, grp, coalesce(tv, '') AS tv FROM (SELECT DISTINCT geo_value, grp FROM snap) LEFT JOIN near USING (geo_value, grp)"""
)
def contributing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nowcast.contributing_values(reports(spark, sf_dir, True), "value", date(2024, 1, 14), 0, 1, LATE)
    return out.withColumn("tv", F.array_join(F.transform("tv", lambda x: F.concat_ws(":", x["time_value"].cast("string"), x["key_version"].cast("string"))), " "))


@query(TABLES + _SPECS + _FEATURES + _WIDE + """ SELECT geo_value, grp, n, round(CASE WHEN n >= 10 THEN s END, 6) AS slope, round(CASE WHEN n >= 10 THEN i END, 2) AS intercept FROM (
SELECT geo_value, grp, CAST(regr_count(target, value_p0_w1) AS BIGINT) AS n, CASE WHEN regr_sxx(target, value_p0_w1) <> 0 THEN regr_slope(target, value_p0_w1) END AS s,
CASE WHEN regr_sxx(target, value_p0_w1) = 0 THEN avg(target) FILTER (value_p0_w1 IS NOT NULL) ELSE regr_intercept(target, value_p0_w1) END AS i FROM training GROUP BY ALL)""")
def normalization_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nowcast.ols_by(_training(spark, sf_dir), list(KEYS), "target", "value_p0_w1")
    return out.select(*KEYS, "n", F.round("slope", 6).alias("slope"), F.round("intercept", 2).alias("intercept"))


def _swept(columns: list[str], gram: str) -> str:
    """SQL that sweeps the centred sums of products of ``columns`` (s_i_j, the last the target) one column after the other."""
    m, at, steps = len(columns), gram, []
    name = lambda i, j: f"s_{max(i, j)}_{min(i, j)}"
    for p in range(m - 1):
        rest = [(i, j) for i in range(m) for j in range(i + 1) if i > p and j > p]
        own = f"CASE WHEN {name(p, p)} > 1e-9 * d_{p} AND d_{p} > 0 THEN {name(p, p)} END"
        told = [f"coalesce({name(i, j)} - {name(i, p)} * {name(j, p)} / ({own}), {name(i, j)}) AS {name(i, j)}" for i, j in rest]
        row = [f"{name(i, p)} / ({own}) AS r_{p}_{i}" for i in range(p + 1, m)]
        steps.append(f"swept{p} AS (SELECT * EXCLUDE ({', '.join(name(i, j) for i, j in rest)}), {', '.join(told + row)} FROM {at})")
        at = f"swept{p}"
    return ", ".join(steps)


def _solved(m: int, least: int) -> str:
    """Back substitution: each coefficient from the row of its pivot and the later ones."""
    out, ctes = [], []
    at = f"swept{m - 2}"
    for p in range(m - 2, -1, -1):
        told = f"r_{p}_{m - 1}" + "".join(f" - r_{p}_{q} * coalesce(b_{q}, 0)" for q in range(p + 1, m - 1))
        ctes.append(f"back{p} AS (SELECT *, {told} AS b_{p} FROM {at})")
        at = f"back{p}"
        out.append(f"b_{p}")
    return ", ".join(ctes)


_FOUR = [*_NAMES, "target"]
_GRAM = ", gram AS (SELECT geo_value, grp, count(*) AS n, " + ", ".join(f"avg({c}::DOUBLE) AS m_{k}" for k, c in enumerate(_FOUR)) + ", " + ", ".join(f"covar_pop({_FOUR[i]}::DOUBLE, {_FOUR[j]}::DOUBLE) * count(*) AS s_{i}_{j}" for i in range(5) for j in range(i + 1)) + ", " + ", ".join(f"var_pop({c}::DOUBLE) * count(*) AS d_{k}" for k, c in enumerate(_FOUR)) + " FROM training WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _FOUR) + " GROUP BY ALL)"


@query(
    TABLES + _SPECS + _FEATURES + _WIDE + f"{_GRAM}, {_swept(_FOUR, 'gram')}, {_solved(5, 6)} SELECT geo_value, grp, n, round(CASE WHEN n >= 6 THEN m_4 - "
    + " - ".join(f"coalesce(b_{k}, 0) * m_{k}" for k in range(4)) + " END, 1) AS intercept, " + ", ".join(f"round(CASE WHEN n >= 6 THEN b_{k} END, 4) AS {c}" for k, c in enumerate(_NAMES))
    + ", round(CASE WHEN n >= 6 AND d_4 > 0 THEN 1 - greatest(s_4_4, 0) / d_4 END, 6) AS r2 FROM back0"
)
def ols_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target on all four features at once; SQL sweeps the normal equations."""
    out = nowcast.ols_many(_training(spark, sf_dir), list(KEYS), "target", _NAMES, least=6)
    return out.select(*KEYS, "n", F.round("intercept", 1).alias("intercept"), *[F.round(c, 4).alias(c) for c in _NAMES], F.round("r2", 6).alias("r2"))


# The best line of least absolute deviations goes through two points, or has slope 0 where x is constant: SQL tries all.
_LINES = (
    TABLES + _SPECS + _FEATURES + _WIDE
    + ", long AS (" + " UNION ALL ".join(f"SELECT geo_value, grp, time_value, '{n}' AS feature, {n}::DOUBLE AS x, target::DOUBLE AS y FROM training WHERE {n} IS NOT NULL AND target IS NOT NULL" for n in _NAMES)
    + """), near AS MATERIALIZED (SELECT * FROM long QUALIFY rank() OVER (PARTITION BY geo_value, grp, feature ORDER BY abs(date_diff('day', DATE '2024-01-20', time_value))) <= 8),
lines AS (
  SELECT a.geo_value, a.grp, a.feature, (b.y - a.y) / (b.x - a.x) AS s, a.y - a.x * (b.y - a.y) / (b.x - a.x) AS i FROM near a JOIN near b ON a.geo_value = b.geo_value AND a.grp = b.grp AND a.feature = b.feature AND a.x < b.x
  UNION SELECT geo_value, grp, feature, 0, y FROM near),
tried AS (SELECT l.geo_value, l.grp, l.feature, s, i, avg(abs(y - s * x - i)) AS left_over FROM lines l JOIN near p ON p.geo_value = l.geo_value AND p.grp = l.grp AND p.feature = l.feature GROUP BY ALL),
best AS (SELECT geo_value, grp, feature, min(left_over) AS score FROM tried GROUP BY ALL),
sizes AS (SELECT geo_value, grp, feature, count(*) AS n FROM near GROUP BY ALL)
SELECT geo_value, grp, feature, n, round(CASE WHEN n >= 4 THEN score END, 4) AS score FROM sizes JOIN best USING (geo_value, grp, feature)"""
)


@query(_LINES)
def feature_score_lad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = nowcast.score_features(_training(spark, sf_dir), _NAMES, "target", list(KEYS), time="time_value", reference=TEST_TIME, nearest=8)
    return out.withColumn("score", F.round("score", 4))


@query(_LINES.replace(" QUALIFY rank() OVER (PARTITION BY geo_value, grp, feature ORDER BY abs(date_diff('day', DATE '2024-01-20', time_value))) <= 8", "").replace("END, 4)", "END, 2)"))
def feature_score_lad_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of each feature, fitted by rounds of sums over Spark's partitions."""
    out = nowcast.score_features(_training(spark, sf_dir), _NAMES, "target", list(KEYS), most=0)
    return out.withColumn("score", F.round("score", 2))


@query(TABLES + "SELECT geo_value, grp, time_value, value, value / avg(value) OVER (PARTITION BY geo_value, grp) AS scaled FROM latest")
def mean_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nowcast.mean_scaled(_latest(spark, sf_dir).drop("n"), list(KEYS), "value", "scaled")


# Groups


@query(TABLES + "SELECT geo_value, CAST(count(*) AS BIGINT) AS rows, CAST(max(value) - min(value) AS BIGINT) AS spread FROM latest GROUP BY ALL")
def group_modify(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(rows: pd.DataFrame, key: dict) -> pd.DataFrame:
        return pd.DataFrame({"rows": [len(rows)], "spread": [int(rows["value"].max() - rows["value"].min())]})

    return grouping.group_modify(_latest(spark, sf_dir), ["geo_value"], f, "rows long, spread long")


@query("SELECT n_nationkey, CAST(count(c_custkey) AS BIGINT) AS size FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 AND c_mktsegment = 'BUILDING' GROUP BY ALL")
def group_nest_keep_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 9000 AND c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey")
    out = grouping.group_nest(customers, ["n_nationkey"], table(spark, sf_dir, "nation").select("n_nationkey"))
    return out.select("n_nationkey", F.size("data").cast("long").alias("size"))


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL HAVING count(*) >= 12")
def having_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.having_many(table(spark, sf_dir, "orders"), ["o_custkey"], 12)


# Shapes, sets and order


@query(TABLES + "SELECT geo_value, grp, time_value, 'value' AS name, value FROM latest UNION ALL SELECT geo_value, grp, time_value, 'n', n FROM latest")
def pivot_longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.pivot_longer(_latest(spark, sf_dir), ["value", "n"])


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(TABLES + "SELECT grp, time_value, " + ", ".join(f"max(value) FILTER (geo_value = '{t}') AS \"{t}\"" for t in _TYPES) + " FROM latest GROUP BY ALL")
def pivot_wider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.pivot_wider(_latest(spark, sf_dir), ["grp", "time_value"], "geo_value", "value", _TYPES)


@query(TABLES + "SELECT * FROM latest")
def pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.unpack(shaping.pack(_latest(spark, sf_dir), "vals", ["value", "n"]), "vals")


@query(TABLES + "SELECT * FROM latest")
def nest_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.unnest(shaping.nest(_latest(spark, sf_dir), list(KEYS)))


@query(TABLES + ", spans AS (SELECT geo_value, grp, min(time_value) AS a, max(time_value) AS b FROM latest WHERE value % 3 = 0 GROUP BY ALL), grid AS (SELECT geo_value, grp, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS time_value FROM spans) SELECT g.*, l.value, l.n FROM grid g LEFT JOIN (SELECT * FROM latest WHERE value % 3 = 0) l USING (geo_value, grp, time_value)")
def complete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.complete_grid(_latest(spark, sf_dir).where("value % 3 = 0"), list(KEYS))


@query("SELECT n_nationkey, coalesce(k, 0) AS k FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON s_nationkey = n_nationkey")
def complete_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    return shaping.complete(counts, table(spark, sf_dir, "nation").select("n_nationkey"), {"k": 0})


@query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY abs(p_size - 25)) <= 3")
def top_k_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.top_with_ties(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], F.abs(F.col("p_size") - 25), 3)


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def distinct_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return shaping.distinct_by(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS nation, c_custkey, NULL::BIGINT AS s_suppkey FROM customer UNION ALL SELECT s_nationkey, NULL, s_suppkey FROM supplier")
def union_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    return shaping.union_fill(a, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey"))


@query("SELECT l_orderkey, CAST(run AS BIGINT) AS run, any_value(l_returnflag) AS l_returnflag, min(l_linenumber) AS start, count(*) AS length FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS run FROM (SELECT *, row_number() OVER w = 1 OR l_returnflag IS DISTINCT FROM lag(l_returnflag) OVER w AS fresh FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))) GROUP BY ALL")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice")
    once = shaping.distinct_by(lines, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")])
    return shaping.run_lengths(once.select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_orderkey"], "l_linenumber", "l_returnflag")


@query(TABLES + "SELECT geo_value, grp, time_value, value, lag(value, 1) OVER w AS lag1, lag(value, 7) OVER w AS lag7 FROM latest WINDOW w AS (PARTITION BY geo_value, grp ORDER BY time_value)")
def lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("time_value")
    return _latest(spark, sf_dir).select(*EKT, "value", F.lag("value", 1).over(w).alias("lag1"), F.lag("value", 7).over(w).alias("lag7"))


@query(TABLES + ", fold AS (SELECT geo_value, grp, list_reduce(list_prepend(0::BIGINT, list(value ORDER BY time_value)), lambda a, x: (a * 31 + x) % 1000003) AS reduced FROM latest GROUP BY ALL) SELECT * FROM fold")
def ordered_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.ordered_reduce(_latest(spark, sf_dir), list(KEYS), "time_value", "value", F.lit(0).cast("long"), lambda a, x: (a * 31 + x) % 1000003)


@query("SELECT p_partkey, p_brand || ' / ' || p_type AS pasted, printf('%s-%05d', p_brand, p_size) AS glued, regexp_replace(p_name, '[aeiou]', '_', 'g') AS subbed, strftime(DATE '2024-02-02', '%Y%m%d') AS formatted FROM part")
def scalar_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws(" / ", "p_brand", "p_type").alias("pasted"), F.format_string("%s-%05d", "p_brand", "p_size").alias("glued"),
        F.regexp_replace("p_name", "[aeiou]", "_").alias("subbed"), F.date_format(F.lit(date(2024, 2, 2)), "yyyyMMdd").alias("formatted"),
    )


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 10 AS plus, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS since, CAST(dayofweek(o_orderdate) AS INTEGER) AS wday FROM orders")
def scalar_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), F.date_add(d, 10).alias("plus"), F.datediff(d, F.lit(date(1995, 1, 1))).alias("since"), (F.dayofweek(d) - 1).alias("wday"))


@query("SELECT s_suppkey, round(1 / (1 + exp(-s_acctbal / 1000)), 9) AS plogis, abs(s_acctbal) AS size, floor(s_acctbal / 7)::BIGINT AS whole, s_suppkey % 7 AS rest, round(sin(s_suppkey) * cos(s_suppkey) + pi(), 9) AS wave, CASE WHEN s_acctbal < 0 THEN 'low' WHEN s_acctbal < 5000 THEN 'mid' ELSE 'high' END AS class FROM supplier")
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, k = F.col("s_acctbal"), F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k, F.round(1 / (1 + F.exp(-a / 1000)), 9).alias("plogis"), F.abs(a).alias("size"), F.floor(a / 7).cast("long").alias("whole"), (k % 7).alias("rest"),
        F.round(F.sin(k) * F.cos(k) + F.pi(), 9).alias("wave"), F.when(a < 0, "low").when(a < 5000, "mid").otherwise("high").alias("class"),
    )


@query("SELECT s_nationkey, list_count(l) AS size, l[1] AS first, l[len(l)] AS last, list_contains(l, 7) AS has7, len(list_concat(l, l)) AS twice FROM (SELECT s_nationkey, list(s_suppkey ORDER BY s_suppkey) AS l FROM supplier GROUP BY ALL)")
def scalar_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("l"))
    return listed.select("s_nationkey", F.size("l").cast("long").alias("size"), F.col("l")[0].alias("first"), F.element_at("l", -1).alias("last"), F.array_contains("l", 7).alias("has7"), F.size(F.concat("l", "l")).cast("long").alias("twice"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, count(*) AS n, median(l_quantity) AS mid, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY ALL")
def summarise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").cast("double").alias("sum_qty"), F.count("*").alias("n"), F.median("l_quantity").alias("mid"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"),
    )


# Files


@query(TABLES + _compact_sql("del"))
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive with its keys checked, made compact, written by version, and read again."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    made = as_archive(reports(spark, sf_dir, True).df, KEYS, versions_end=date(2024, 3, 1))
    write_archive(made, at)
    return as_archive(read_archive(spark, at).df, KEYS).df


@query(TABLES + _compact_sql("del"))
def rewrite_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive whose last versions were published in a draft and then rewritten equals one made of the final rows."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    final = reports(spark, sf_dir, True)
    old = F.col("version") < LATE
    draft = final.df.withColumns({"value": F.when(old, F.col("value")).otherwise(F.col("value") + 1), "version": F.when(old, F.col("version")).otherwise(F.date_add("version", 1))})
    write_archive(as_archive(draft, KEYS, clobberable_versions_start=LATE), at)
    return tables.rewrite_tail(spark, at, final.df.where(~old), LATE).df


@query(TABLES + _SNAPSHOTS)
def load_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of snapshots that lie in a folder each, loaded by Spark's tasks one version at a time."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    a = reports(spark, sf_dir, True)
    travel.as_of_each(a).where("value IS NOT NULL").repartition("version").write.partitionBy("version").parquet(at)
    versions = [r["version"] for r in a.df.select("version").distinct().collect()]  # the snapshots' names
    folder = at.removeprefix("file:")

    def load(version: date) -> list[tuple]:
        import pyarrow.dataset as ds

        try:
            found = ds.dataset(f"{folder}/version={version}", format="parquet")
        except FileNotFoundError:  # an empty snapshot
            return []
        return [tuple(r.values()) for r in found.to_table(["geo_value", "grp", "time_value", "value", "n"]).to_pylist()]

    return snapshots.load_archive(spark, versions, load, "geo_value string, grp long, time_value date, value long, n long", EKT).select(*EKT, "version", "value", "n")


# Rows


@query("SELECT event_id, user_id % 7 AS u, event_type, min(event_id) OVER (PARTITION BY user_id % 7, event_type, CASE WHEN value < 20 THEN NULL ELSE floor(value / 50) END, date_part('hour', ts)) AS first_id FROM events")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event that equals each in all columns, nested ones and nulls among them."""
    part = F.when(F.col("value") >= 20, F.floor(F.col("value") / 50)).otherwise(F.lit(None))
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("u"), "event_type", F.struct(part.alias("part"), F.array(F.hour("ts"), F.lit(None)).alias("hours")).alias("nested"))
    return shaping.first_ids(events, "event_id").drop("nested")


# Streams


@query(TABLES + _compact_sql("arch", "value IS DISTINCT FROM pv", "value, false AS late", "lag(value) OVER w AS pv"))
def stream_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive, read as a stream of files and kept compact by state."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    batch = reports(spark, sf_dir).df.drop("n")
    batch.write.parquet(f"{at}/updates")
    stream = spark.readStream.schema(batch.schema).parquet(f"{at}/updates")
    made = compact_stream(stream, list(KEYS), "value")
    made.writeStream.format("parquet").option("path", f"{at}/archive").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/archive")


_SLIDE_STREAM = _archive_slide_sql("CAST(sum(value) OVER w AS BIGINT)", "value_7dsum", 6, 0)


@query(_SLIDE_STREAM.replace("time_value, version, value_7dsum FROM (SELECT *, row_number()", "time_value, version, value_7dsum, false AS late FROM (SELECT *, row_number()"))
def stream_archive_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly sums at every version, from updates that arrive in three lots of files; the state forgets what is over ten days older than the newest."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    batch = reports(spark, sf_dir, True).df.drop("n")
    with state_store(spark):
        for first, last in ((date(2023, 1, 1), EARLY), (EARLY, LATE), (LATE, date(2099, 1, 1))):
            batch.where((F.col("version") >= first) & (F.col("version") < last)).write.mode("append").parquet(f"{at}/updates")
            made = slide_stream(spark.readStream.schema(batch.schema).parquet(f"{at}/updates"), list(KEYS), ["value"], "sum", 7, lag=10)
            made.writeStream.format("parquet").option("path", f"{at}/archive").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/archive")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted by day of event time, read as a stream; a last event far in the future lets the watermark close every window."""
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(f"{at}/events/part=1")
    last = events.agg(F.max("ts").alias("ts"))
    last.select((F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit("end").alias("event_type")).write.parquet(f"{at}/events/part=2")
    stream = spark.readStream.schema(events.schema).parquet(f"{at}/events/part=*")
    made = windowed_counts(stream, "ts", ["event_type"], "1 day", "30 days")
    made.writeStream.format("parquet").option("path", f"{at}/counts").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/counts").where("event_type <> 'end'").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(TABLES + f"SELECT geo_value, grp, time_value, value_7dsum AS value, value_7dsum - before AS revision FROM (SELECT * EXCLUDE t FROM ({_slide_sql('CAST(sum(value) OVER w AS BIGINT)', 'value_7dsum', 6, 0, src='(' + _as_of_sql('2024-01-20', 'arch') + ')')})) LEFT JOIN (SELECT geo_value, grp, time_value, value_7dsum AS before FROM ({_slide_sql('CAST(sum(value) OVER w AS BIGINT)', 'value_7dsum', 6, 0, src='(' + _as_of_sql('2024-01-13', 'arch') + ')')})) USING (geo_value, grp, time_value)")
def revision_of_weekly_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly sums as known on a day, and how they were revised within a week."""
    a = reports(spark, sf_dir)
    week = lambda v: sliding.slide(travel.as_of(a, v).df, list(KEYS), ["value"], "sum", 7).select(*EKT, "value_7dsum")
    old = week(date(2024, 1, 13)).withColumnRenamed("value_7dsum", "before")
    return week(date(2024, 1, 20)).join(old, EKT, "left").select(*EKT, F.col("value_7dsum").alias("value"), (F.col("value_7dsum") - F.col("before")).alias("revision"))
