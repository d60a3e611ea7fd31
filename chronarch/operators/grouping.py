"""Computations by group, groups without rows included."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _schema(df: DataFrame, by: list[str], made: str) -> str:
    new = StructType.fromDDL(made)
    if clash := sorted(set(new.names) & set(by)):
        raise ValueError(f"the function's result has group columns: {clash}")
    return ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), *(f"`{x.name}` {x.dataType.simpleString()}" for x in new.fields)])


def group_modify(df: DataFrame, by: list[str], f: Callable[[pd.DataFrame, dict], pd.DataFrame], schema: str) -> DataFrame:
    """``f(rows, key)`` of each group, with the group's columns before its own.

    ``schema`` is that of what f returns, which must not have the group columns.  A
    group is one task's, so this is for functions that no SQL aggregate gives.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = f(rows.drop(columns=by), dict(zip(by, key)))
        for at, (c, v) in enumerate(zip(by, key)):
            out.insert(at, c, v)
        return out

    return df.groupBy(*by).applyInPandas(run, _schema(df, by, schema))


def group_nest(df: DataFrame, by: list[str], domain: DataFrame | None = None, name: str = "data") -> DataFrame:
    """One row for each group with an array of its rows; with ``domain``, also for groups without rows."""
    rest = [c for c in df.columns if c not in by]
    nested = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    if domain is None:
        return nested
    kind = nested.schema[name].dataType.simpleString()
    return domain.join(nested, by, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def group_keys(df: DataFrame, by: list[str]) -> DataFrame:
    return df.select(*by).distinct()


def having_many(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """(by, n) of groups of at least ``least`` rows."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= least)
