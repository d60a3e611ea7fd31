"""Removal of rows that repeat what was known before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronarch.functions.equality import all_equal


def is_repeat(df: DataFrame, ekt: list[str], version: str = "version", tol: float = 0, values: list[str] | None = None) -> Column:
    """Whether a row's values equal those of the version before (which may itself be a repeat)."""
    values = values or [c for c in df.columns if c not in (*ekt, version)]
    own = F.struct(*values)
    before = F.lag(own).over(Window.partitionBy(*ekt).orderBy(version))
    return before.isNotNull() & all_equal(own, before, df.schema, values, tol)


def compactify(df: DataFrame, ekt: list[str], version: str = "version", tol: float = 0, values: list[str] | None = None) -> DataFrame:
    """``df`` without repeats.  Each row is compared with its immediate predecessor, so a drift in small steps is dropped whole.

    Nulls equal nulls; the first row of a key stays even if all its values are null.
    """
    return df.withColumn("__repeat", is_repeat(df, ekt, version, tol, values)).where("NOT __repeat").drop("__repeat")
