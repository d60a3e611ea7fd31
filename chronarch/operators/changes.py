"""Differences of snapshots, patches, and archives made of sequences of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronarch.archive import Snapshot
from chronarch.functions.equality import all_equal
from chronarch.operators.compaction import compactify
from chronarch.sources.tables import cut


def _same_key(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def diff(earlier: DataFrame | None, later: DataFrame, keys: list[str], later_format: str = "snapshot", tol: float = 0) -> DataFrame:
    """The rows that turn ``earlier`` into ``later``: additions, changes, and deletions with null values.

    In the format "update", later has changed rows only, and nothing is deleted.
    Without an earlier table, later is the difference.
    """
    if later_format not in ("snapshot", "update"):
        raise ValueError("later_format must be snapshot or update")
    if earlier is None:
        return later
    if earlier.columns != later.columns:
        raise ValueError("both tables need the same columns in the same order")
    if missing := [k for k in keys if k not in later.columns]:
        raise ValueError(f"keys are missing: {missing}")
    values = [c for c in later.columns if c not in keys]
    one = earlier.select(*keys, F.struct(F.lit(1).alias("__here"), *values).alias("__old")).alias("a")
    two = later.select(*keys, F.struct(F.lit(1).alias("__here"), *values).alias("__new")).alias("b")
    both = two.join(one, _same_key("b", "a", keys), "full_outer" if later_format == "snapshot" else "left")
    old, new = F.col("__old"), F.col("__new")
    same = old.isNotNull() & new.isNotNull() & all_equal(old, new, later.schema, values, tol)
    key = [F.when(new.isNotNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys]
    out = both.where(~same).select(*key, *[new[v].alias(v) for v in values])
    return out.select(later.columns)


def snapshot_diff(earlier: Snapshot | None, later: Snapshot, later_format: str = "snapshot", tol: float = 0) -> DataFrame:
    """``diff`` of two snapshots, which must be of one kind and in order."""
    if earlier is not None:
        if (earlier.keys, earlier.time) != (later.keys, later.time):
            raise ValueError("the snapshots have different keys")
        if earlier.as_of >= later.as_of:
            raise ValueError("the later snapshot's version must be greater")
    return diff(earlier and earlier.df, later.df, later.ekt, later_format, tol)


def patch(snapshot: DataFrame | None, update: DataFrame, keys: list[str]) -> DataFrame:
    """``snapshot`` with the rows of ``update`` in place of those with the same keys; deletions stay as rows with null values."""
    if snapshot is None:
        return update
    kept = snapshot.alias("a").join(update.select(*keys).alias("b"), _same_key("a", "b", keys), "left_anti")
    return update.unionByName(kept.select(update.columns))


def snapshot_patch(snapshot: Snapshot, update: Snapshot) -> Snapshot:
    if (snapshot.keys, snapshot.time) != (update.keys, update.time):
        raise ValueError("snapshot and update have different keys")
    if snapshot.as_of >= update.as_of:
        raise ValueError("the update's version must be greater")
    return Snapshot(patch(snapshot.df, update.df, snapshot.ekt), update.as_of, snapshot.keys, snapshot.time)


def snapshots_to_archive(snapshots: DataFrame, ekt: list[str], version: str = "version", tol: float = 0, versions: DataFrame | None = None) -> DataFrame:
    """The compact archive of whole snapshots, one for each version, with their deletions.

    Each row looks at its key's rows in the versions next to it, so the fold over
    versions is one window by key.  ``versions`` names all versions, which matters
    where a snapshot is empty.  Rows of the first version stay, whatever they hold.
    """
    values = [c for c in snapshots.columns if c not in (*ekt, version)]
    every = (versions.select(version) if versions is not None else snapshots.select(version)).distinct()
    by = Window.orderBy(version)  # of distinct versions: a few thousand
    order = every.select(version, F.lag(version).over(by).alias("__before"), F.lead(version).over(by).alias("__after"))
    w = Window.partitionBy(*ekt).orderBy(version)
    own = F.struct(version, *values)
    rows = snapshots.join(order, version).withColumns({"__last": F.lag(own).over(w), "__next": F.lead(F.struct(version)).over(w)})
    last = F.col("__last")
    repeat = F.coalesce(last[version] == F.col("__before"), F.lit(False)) & all_equal(own, last, snapshots.schema, values, tol)
    gone = F.col("__after").isNotNull() & F.coalesce(F.col("__next")[version] != F.col("__after"), F.lit(True))
    out = F.array_compact(F.array(
        F.when(~repeat, F.struct(F.col(version).alias(version), *[F.col(v).alias(v) for v in values])),
        F.when(gone, F.struct(F.col("__after").alias(version), *[F.lit(None).cast(snapshots.schema[v].dataType).alias(v) for v in values])),
    ))
    return rows.select(*ekt, F.inline(out)).select(snapshots.columns)


def updates_to_archive(updates: DataFrame, ekt: list[str], version: str = "version", tol: float = 0) -> DataFrame:
    """The compact archive of updates, one for each version; keys that an update leaves out keep their values."""
    return compactify(updates, ekt, version, tol)


def load_snapshots(versions: list, load: Callable[[object], DataFrame], ekt: list[str], tol: float = 0) -> DataFrame:
    """An archive of the snapshots that ``load`` gives for each version, deletions found."""
    versions = sorted(set(versions))
    frames = [load(v).withColumn("version", F.lit(v)) for v in versions]
    spark = frames[0].sparkSession
    every = spark.createDataFrame([(v,) for v in versions], frames[0].select("version").schema)
    return snapshots_to_archive(reduce(DataFrame.unionByName, frames), ekt, "version", tol, every)


def map_versions(df: DataFrame, f: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str, ekt: list[str], version: str = "version", by: list[str] | None = None, tol: float = 0, result: str = "snapshot") -> DataFrame:
    """The archive of ``f(version, rows)`` for each version's rows (and each group of ``by``)."""
    name = version

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return f(key[0], rows).assign(**{name: key[0]} | dict(zip(by or [], key[1:])))

    mapped = df.groupBy(version, *(by or [])).applyInPandas(run, schema)
    return snapshots_to_archive(mapped, ekt, version, tol) if result == "snapshot" else updates_to_archive(mapped, ekt, version, tol)


def map_accumulate(df: DataFrame, f: Callable[[object, object, pd.DataFrame], tuple[object, pd.DataFrame]], init: object, schema: str, by: list[str], ekt: list[str], version: str = "version", tol: float = 0, result: str = "snapshot") -> DataFrame:
    """The archive of a fold over versions in each group of ``by``.

    ``f(accumulator, version, rows)`` gives the next accumulator and the rows of the
    result at that version.  Groups run apart, each in one task, so a group's rows
    have to fit there; the accumulator never crosses groups.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, out = init, []
        for v, part in rows.groupby(version, sort=True):
            told = f(state, v, part)
            if not isinstance(told, tuple) or len(told) != 2:
                raise ValueError("f must return the accumulator and the rows")
            state, made = told
            out.append(made.assign(**{version: v} | dict(zip(by, key))))
        return pd.concat(out, ignore_index=True)

    mapped = df.groupBy(*by).applyInPandas(run, schema)
    return snapshots_to_archive(mapped, ekt, version, tol) if result == "snapshot" else updates_to_archive(mapped, ekt, version, tol)


def fold_versions(df: DataFrame, f: Callable[[object, object, pd.DataFrame], tuple[object, pd.DataFrame]], init: object, schema: str, by: list[str], ekt: list[str], kind: str, version: str = "version", tol: float = 0, result: str = "snapshot", name: str = "accumulator") -> tuple[DataFrame, DataFrame]:
    """``map_accumulate``'s archive and ``last_accumulator``'s table from one pass: f runs once for each version of a group.

    Both read what the pass left in the shared folder.
    """
    kinds = {x.name: x.dataType.simpleString() for x in df.schema.fields}
    made = T.StructType.fromDDL(schema)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state, out = init, []
        for v, part in rows.groupby(version, sort=True):
            told = f(state, v, part)
            if not isinstance(told, tuple) or len(told) != 2:
                raise ValueError("f must return the accumulator and the rows")
            state, own = told
            out.append(own.assign(**{version: v} | dict(zip(by, key))))
        last = pd.DataFrame([(*key, state, True)], columns=[*by, "__state", "__end"])
        whole = pd.concat([*[o.assign(__end=False) for o in out], last], ignore_index=True)
        return whole.astype({c: object for c in made.names}).where(whole.notna(), None).reindex(columns=[*made.names, "__state", "__end"])

    whole = cut(df.groupBy(*by).applyInPandas(run, f"{schema}, `__state` {kind}, `__end` boolean"))
    rows = whole.where("NOT __end").select(*made.names)
    archive = snapshots_to_archive(rows, ekt, version, tol) if result == "snapshot" else updates_to_archive(rows, ekt, version, tol)
    return archive, whole.where("__end").select(*[F.col(c).cast(kinds[c]) for c in by], F.col("__state").alias(name))


def last_accumulator(df: DataFrame, f: Callable[[object, object, pd.DataFrame], tuple[object, pd.DataFrame]], init: object, by: list[str], kind: str, version: str = "version", name: str = "accumulator") -> DataFrame:
    """(by, accumulator of the type ``kind``): what the fold of ``map_accumulate`` holds after the last version of each group."""
    kinds = {x.name: x.dataType.simpleString() for x in df.schema.fields}

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        state = init
        for v, part in rows.groupby(version, sort=True):
            state, _ = f(state, v, part)
        return pd.DataFrame([(*key, state)], columns=[*by, name])

    return df.groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + f", `{name}` {kind}")
