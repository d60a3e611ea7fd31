"""Archives as of a version, merged archives, and lookups of what was known."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronarch.archive import Archive, Snapshot
from chronarch.functions.steps import containing_time, shifted, zero_lag_version
from chronarch.operators.compaction import compactify


def as_of(archive: Archive, version) -> Snapshot:
    """The snapshot at ``version``; the filter reaches the scan, and the newest row wins before the shuffle."""
    known = archive.df.where(F.col(archive.version) <= F.lit(version))
    newest = known.groupBy(*archive.ekt).agg(F.max_by(F.struct(*archive.values), archive.version).alias("v"))
    return Snapshot(newest.select(*archive.ekt, "v.*"), version, archive.keys, archive.time)


def as_of_latest(archive: Archive) -> Snapshot:
    """The snapshot at the last version; without a filter, where the archive doesn't tell its end."""
    if archive.versions_end is not None:
        return as_of(archive, archive.versions_end)
    newest = archive.df.groupBy(*archive.ekt).agg(F.max_by(F.struct(*archive.values), archive.version).alias("v"))
    return Snapshot(newest.select(*archive.ekt, "v.*"), archive.df.agg(F.max(archive.version)).first()[0], archive.keys, archive.time)


def truncate(archive: Archive, version) -> Archive:
    """The archive as it was at ``version``, with all its versions."""
    return archive.of(archive.df.where(F.col(archive.version) <= F.lit(version)), versions_end=version)


def _places(archive: Archive, versions: list | None) -> tuple[DataFrame, DataFrame]:
    """((version, before, most), (place, at)): how many of the wanted versions come before each, and in all; and the wanted ones by place from 1.

    Both have a row for each distinct version, however many rows the archive has.
    """
    name, kind = archive.version, archive.df.schema[archive.version].dataType
    own = archive.df.select(F.col(name).alias("v"))
    if versions is None:
        every = own.distinct().withColumn("is", F.lit(1))
    else:
        wanted = archive.df.sparkSession.createDataFrame([(v,) for v in versions], T.StructType([T.StructField("v", kind)]))
        every = wanted.withColumn("is", F.lit(1)).union(own.withColumn("is", F.lit(0))).groupBy("v").agg(F.max("is").alias("is"))
    order = Window.orderBy("v")  # of distinct versions: a few thousand
    every = every.withColumns({"place": F.sum("is").over(order), "most": F.sum("is").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return every.select("v", (F.col("place") - F.col("is")).alias("before"), "most"), every.where(F.col("is") == 1).select("place", F.col("v").alias("__at"))


def as_of_each(archive: Archive, versions: list | None = None) -> DataFrame:
    """The rows known at each of ``versions`` (all of the archive, if None), with a column version.

    Every row knows the places of the first and last wanted version within its time
    of validity, so work grows with the result, not with rows times versions.
    """
    name = archive.version
    before, places = _places(archive, versions)
    rows = archive.df.join(before.select(F.col("v").alias(name), F.col("before").alias("__from"), F.col("most").alias("__most")), name)
    # A row holds until the place of its key's next one.
    after = F.lead("__from").over(Window.partitionBy(*archive.ekt).orderBy(name))
    rows = rows.withColumn("__last", F.coalesce(after, "__most")).where(F.col("__from") < F.col("__last"))
    rows = rows.withColumn("place", F.explode(F.sequence(F.col("__from") + 1, F.col("__last"))))
    return rows.join(places, "place").select(*archive.ekt, F.col("__at").alias(name), *archive.values)


def history_at_each(archive: Archive, versions: list | None = None) -> DataFrame:
    """All rows published up to each of ``versions``, with a column as_of_version: the truncated archive at each of them."""
    before, places = _places(archive, versions)
    rows = archive.df.join(before.select(F.col("v").alias(archive.version), F.col("before").alias("__from"), F.col("most").alias("__most")), archive.version)
    rows = rows.where(F.col("__from") < F.col("__most")).withColumn("place", F.explode(F.sequence(F.col("__from") + 1, F.col("__most"))))
    return rows.join(places, "place").select(*archive.df.columns, F.col("__at").alias("as_of_version"))


def slide_versions(archive: Archive, f: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, versions: list | None = None, before: int | None = None, by: list[str] | None = None, all_versions: bool = False) -> DataFrame:
    """``f(version, snapshot)`` at each version, for times of the last ``before`` steps, and for each group of ``by``.

    With ``all_versions``, f gets the archive as it was at that version, not the snapshot.
    """
    name = archive.version
    rows = history_at_each(archive, versions) if all_versions else as_of_each(archive, versions)
    at = "as_of_version" if all_versions else name
    if before is not None:
        rows = rows.where(F.col(archive.time) >= shifted(F.col(at), -before, archive.time_type))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return f(key[0], part).assign(**{name: key[0]} | dict(zip(by or [], key[1:])))

    return rows.groupBy(at, *(by or [])).applyInPandas(run, schema)


def merge_locf(x: Archive, y: Archive) -> Archive:
    """One archive with the values of both; at each version of either, the other's last values are carried forward."""
    name = x.version
    if (x.ekt, name) != (y.ekt, y.version):
        raise ValueError("the archives have different keys")
    if clash := set(x.values) & set(y.values):
        raise ValueError(f"columns of both: {sorted(clash)}")
    none = lambda a: F.lit(None).cast(a.df.select(F.struct(*a.values).alias("s")).schema["s"].dataType)
    left = x.df.select(*x.ekt, name, F.struct(*x.values).alias("__x"), none(y).alias("__y"))
    right = y.df.select(*x.ekt, name, none(x).alias("__x"), F.struct(*y.values).alias("__y"))
    both = left.union(right).groupBy(*x.ekt, name).agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("__x", "__y")])
    w = Window.partitionBy(*x.ekt).orderBy(name)
    filled = both.select(*x.ekt, name, *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("__x", "__y")])
    ends = [e for e in (x.versions_end, y.versions_end) if e is not None]
    return x.of(filled.select(*x.ekt, name, "__x.*", "__y.*"), versions_end=min(ends, default=None))


def confirmation_keys(archive: Archive, column: str) -> DataFrame:
    """(entity, time, version) at which ``column`` was reported, changed or not."""
    return archive.df.where(F.col(column).isNotNull()).select(*archive.ekt, archive.version)


def change_keys(archive: Archive, columns: list[str]) -> DataFrame:
    """(entity, time, version) at which one of ``columns`` changed."""
    kept = archive.df.select(*archive.ekt, archive.version, *columns)
    return compactify(kept, archive.ekt, archive.version).select(*archive.ekt, archive.version)


def corresponding_versions(rows: DataFrame, keys: DataFrame, archive: Archive, as_of_version, name: str = "key_version") -> DataFrame:
    """``rows`` with the newest version of ``keys`` at most ``as_of_version`` for their entity and time; null without one."""
    newest = keys.where(F.col(archive.version) <= F.lit(as_of_version)).groupBy(*archive.ekt).agg(F.max(archive.version).alias(name))
    return rows.join(newest, archive.ekt, "left")


def lookup(archive: Archive, rows: DataFrame, column: str, time: Column, version: Column, name: str, tolerance: int | None = None) -> DataFrame:
    """``rows`` with the value of ``column`` at another time as known at a version: an as-of join.

    ``time`` and ``version`` are expressions over ``rows``.  With ``tolerance``, a
    value found must have a version at most so many steps older.  Facts and the cells that are
    asked for, each once, are sorted by version together; a cell takes the last fact before it,
    so facts are shuffled once and no row meets all versions.
    """
    keys, spot = list(archive.keys), [*archive.keys, "__t"]
    wanted = rows.withColumns({"__t": time, "__v": version})
    needed = wanted.select(*spot, "__v").where(F.col("__v").isNotNull()).dropna(subset=spot).distinct()
    facts = archive.df.select(*keys, F.col(archive.time).alias("__t"), F.col(archive.version).alias("__v"), F.struct(F.col(archive.version).alias("__f"), F.col(column).alias("__x")).alias("__s"))
    both = facts.withColumn("__asked", F.lit(False)).union(needed.select(*spot, "__v", F.lit(None).cast(facts.schema["__s"].dataType).alias("__s"), F.lit(True).alias("__asked")))
    upto = Window.partitionBy(*spot).orderBy("__v", "__asked").rowsBetween(Window.unboundedPreceding, 0)
    newest = both.withColumn("__s", F.last("__s", ignorenulls=True).over(upto)).where(F.col("__asked") & F.col("__s").isNotNull())
    if tolerance is not None:
        newest = newest.where(shifted(F.col("__s.__f"), tolerance, archive.time_type) >= F.col("__v"))
    found = newest.select(*spot, "__v", F.col("__s.__x").alias(name))
    return wanted.join(found, [*spot, "__v"], "left").select(*rows.columns, name)


def lookup_offset(archive: Archive, rows: DataFrame, column: str, offset: int, lag: int = 0, name: str | None = None, tolerance: int | None = None) -> DataFrame:
    """The value ``offset`` steps from a row's time, as known ``lag`` steps after the row's own time."""
    t = F.col(archive.time)
    return lookup(archive, rows, column, shifted(t, offset, archive.time_type), shifted(zero_lag_version(t, archive.time_type), lag, archive.time_type), name or f"{column}_{offset}_{lag}", tolerance)


def lookup_version_lag(archive: Archive, rows: DataFrame, column: str, lag: int, name: str | None = None) -> DataFrame:
    """A row's value as known ``lag`` steps after its time."""
    return lookup_offset(archive, rows, column, 0, lag, name or f"{column}_lag{lag}")


def evaluation_data(archive: Archive, column: str, horizon: int, anchors: DataFrame) -> DataFrame:
    """(entity, anchor_version, target_time, target): for each anchor version, the newest value ``horizon`` steps from its time."""
    latest = archive.df.groupBy(*archive.ekt).agg(F.max_by(F.struct(column), archive.version)[column].alias("target"))
    at = anchors.select(F.col(archive.version).alias("anchor_version")).distinct()
    at = at.withColumn(archive.time, shifted(containing_time(F.col("anchor_version"), archive.time_type), horizon, archive.time_type))
    return at.join(latest, archive.time).select(*archive.keys, "anchor_version", F.col(archive.time).alias("target_time"), "target")


def update_extent(archive: Archive) -> DataFrame:
    """(entity, version, first_time, last_time) that each version's update reaches."""
    return archive.df.groupBy(*archive.keys, archive.version).agg(F.min(archive.time).alias("first_time"), F.max(archive.time).alias("last_time"))
