"""Equality of values with a numeric tolerance, nulls equal to nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def approx_equal(a: Column, b: Column, kind: T.DataType, tol: float = 0) -> Column:
    """Whether ``a`` equals ``b``: never null; null equals null.

    ``tol`` is inclusive and holds for numbers, also within structs.  All other
    types, and all types at tolerance 0, are compared exactly.  Maps cannot be.
    """
    if isinstance(kind, T.MapType):
        raise TypeError("columns of maps cannot be compared")
    if tol and isinstance(kind, T.StructType):
        fields = [approx_equal(a[f.name], b[f.name], f.dataType, tol) for f in kind.fields]
        return (a.isNull() == b.isNull()) & reduce(lambda x, y: x & y, fields)
    exact = a.eqNullSafe(b)
    if tol and isinstance(kind, T.NumericType):
        return exact | F.coalesce(F.abs(a - b) <= tol, F.lit(False))
    return exact


def all_equal(a: Column, b: Column, schema: T.StructType, names: list[str], tol: float = 0) -> Column:
    """Whether the fields ``names`` of the structs ``a`` and ``b`` are all equal."""
    return reduce(lambda x, y: x & y, [approx_equal(a[n], b[n], schema[n].dataType, tol) for n in names], F.lit(True))


def nan_to_null(df: DataFrame, names: list[str]) -> DataFrame:
    """NaN counts as missing."""
    floats = {n: F.when(~F.isnan(n), F.col(n)) for n in names if isinstance(df.schema[n].dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(floats) if floats else df
