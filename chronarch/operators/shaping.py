"""Reshaping, completion, set operations and ordered choices."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronarch.functions.steps import shifted, step


def mutate_new(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns, which must not exist."""
    if clash := sorted(set(columns) & set(df.columns)):
        raise ValueError(f"columns exist already: {clash}")
    return df.withColumns(columns)


def pivot_longer(df: DataFrame, columns: list[str], names_to: str = "name", values_to: str = "value") -> DataFrame:
    return df.unpivot([c for c in df.columns if c not in columns], columns, names_to, values_to)


def pivot_wider(df: DataFrame, keys: list[str], names_from: str, values_from: str, names: list[str]) -> DataFrame:
    """One column for each of ``names``; given, they save a job over the data."""
    return df.groupBy(*keys).pivot(names_from, names).agg(F.first(values_from, ignorenulls=True))


def nest(df: DataFrame, by: list[str], name: str = "data", order: list[str] | None = None) -> DataFrame:
    """One row for each key with an array of its rows, sorted by ``order`` and then the other columns."""
    rest = [*(order or []), *[c for c in df.columns if c not in by and c not in (order or [])]]
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))


def unnest(df: DataFrame, name: str = "data", keep_empty: bool = False) -> DataFrame:
    how = F.inline_outer if keep_empty else F.inline
    return df.select(*[c for c in df.columns if c != name], how(name))


def pack(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """``columns`` as one column of structs."""
    return df.select(*[c for c in df.columns if c not in columns], F.struct(*columns).alias(name))


def unpack(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], f"{name}.*")


def complete(df: DataFrame, domain: DataFrame, fill: dict[str, object] | None = None) -> DataFrame:
    """A row for each key of ``domain``, with ``fill`` where ``df`` has none (its own nulls stay)."""
    on = domain.columns
    rows = domain.join(df.withColumn("__here", F.lit(True)), on, "left")
    filled = [F.when(F.col("__here").isNull(), F.lit((fill or {}).get(c))).otherwise(F.col(c)).alias(c) if c in (fill or {}) else F.col(c) for c in df.columns]
    return rows.select(*filled)


def complete_grid(df: DataFrame, keys: list[str], time: str = "time_value", time_type: str = "day") -> DataFrame:
    """A row for each step between the first and last time of each key; the values of added rows are null."""
    ends = df.groupBy(*keys).agg(F.min(time).alias("__first"), F.max(time).alias("__last"))
    n = step(F.col("__last"), time_type) - step(F.col("__first"), time_type)
    grid = ends.select(*keys, "__first", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("__n"))
    grid = grid.select(*keys, shifted(F.col("__first"), F.col("__n"), time_type).alias(time))
    return grid.join(df, [*keys, time], "left").select(df.columns)


def union_fill(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns that one lacks are null there."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tables)


def distinct_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def _comparable(kind: T.DataType) -> bool:
    """Whether values of the type can be told apart: maps can't, at any depth."""
    if isinstance(kind, T.StructType):
        return all(_comparable(f.dataType) for f in kind.fields)
    return _comparable(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, (T.MapType, T.VariantType))


def _digest(columns: list[Column]) -> Column:
    return F.xxhash64(*columns)


def first_ids(df: DataFrame, id_col: str, columns: list[str] | None = None, name: str = "first_id", digest: Callable[[list[Column]], Column] = _digest) -> DataFrame:
    """``df`` with the least ``id_col`` of the rows that equal it in ``columns`` (all others, if None); a row like no other has its own.

    Nulls equal nulls and NaN equals NaN, also within lists and structs; maps are refused.
    Only digests are counted over all rows; rows whose digest stands more than once are then
    compared as they are, so a clash of digests joins nothing.  ``id_col`` must be unique.
    """
    columns = columns or [c for c in df.columns if c != id_col]
    if bad := [c for c in columns if not _comparable(df.schema[c].dataType)]:
        raise TypeError(f"columns of maps cannot be compared: {bad}")
    told = df.withColumn("__d", digest([F.col(f"`{c}`") for c in columns]))
    again = told.groupBy("__d").agg(F.count("*").alias("__n")).where("__n > 1").select("__d")
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)]).alias("__all")
    suspects = told.join(again, "__d", "left_semi").select("__d", whole, id_col)
    groups = suspects.groupBy("__d", "__all").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    members = suspects.alias("s").join(groups.alias("g"), (F.col("s.__d") == F.col("g.__d")) & F.col("s.__all").eqNullSafe(F.col("g.__all"))).select(F.col(f"s.`{id_col}`"), F.col("g.__first"))
    return df.join(members, id_col, "left").select(*[f"`{c}`" for c in df.columns], F.coalesce("__first", id_col).alias(name))


def any_duplicates(df: DataFrame, id_col: str, columns: list[str] | None = None) -> bool:
    """Whether two rows are equal in ``columns``."""
    return not first_ids(df, id_col, columns, "__first_id").where(F.col("__first_id") != F.col(id_col)).isEmpty()


def top_with_ties(df: DataFrame, by: list[str], value: Column, n: int) -> DataFrame:
    """The ``n`` rows of least value in each group, with all that tie with the last."""
    return df.withColumn("__r", F.rank().over(Window.partitionBy(*by).orderBy(value))).where(F.col("__r") <= n).drop("__r")


def run_lengths(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """(by, run, value, start, length) of stretches of equal values, nulls equal to nulls."""
    w = Window.partitionBy(*by).orderBy(order)
    new = ~(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1))
    runs = df.withColumn("run", F.sum(new.cast("long")).over(w))
    return runs.groupBy(*by, "run").agg(F.first(value).alias(value), F.min(order).alias("start"), F.count("*").alias("length"))


def ordered_reduce(df: DataFrame, by: list[str], order: str, value: str, start: Column, merge, name: str = "reduced") -> DataFrame:
    """A fold over each group's values in order, in SQL's aggregate(); a group's values have to fit in one row."""
    listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("__all"))
    return listed.select(*by, F.aggregate(F.col("__all")[value], start, merge).alias(name))
