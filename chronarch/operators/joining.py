"""Joins as analysts of versioned data use them, on top of Spark's own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _null_safe(a: str, b: str, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{n}`").eqNullSafe(F.col(f"{b}.`{n}`")) for n in names])


def anti_join(x: DataFrame, y: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """Rows of ``x`` without a partner in ``y``; nulls match nulls."""
    return x.alias("x").join(y.select(*by).alias("y"), _null_safe("x", "y", by), "left_anti").select(*(columns or x.columns))


def semi_join_range(x: DataFrame, ranges: DataFrame, by: list[str], value: str, low: str, high: str) -> DataFrame:
    """Rows of ``x`` whose ``value`` lies in a range [low, high] of the same keys."""
    a, b = x.alias("x"), ranges.select(*by, low, high).alias("r")
    inside = F.col(f"x.{value}").between(F.col(f"r.{low}"), F.col(f"r.{high}"))
    return a.join(b, reduce(lambda p, q: p & q, [F.col(f"x.{k}") == F.col(f"r.{k}") for k in by]) & inside, "left_semi")


def _place(c: Column, kind: T.DataType) -> Column:
    """A number that rises with the value."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return (F.unix_micros(c.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c).cast("double")


def _level(low: Column, high: Column) -> Column:
    """The power of two that an interval's length is at most: of bins that long, it touches two, or three by rounding."""
    return F.when(high > low, F.greatest(F.ceil(F.log2(high - low)), F.lit(-60))).otherwise(F.lit(-60)).cast("int")


def in_ranges(points: DataFrame, ranges: DataFrame, by: list[str], value: str, low: str, high: str, inside: Column | None = None) -> DataFrame:
    """Pairs of a point, as x, and a range, as r, of equal ``by`` (none: of all), whose ``value`` lies in [low, high]; each pair once.

    Ranges are cut into bins as long as themselves, up to a power of two, so each is in two
    or three; a point is in one bin of each length that some range has.  Only rows of one bin
    meet.  Nulls, and ranges that end before they begin, meet nothing.
    """
    kind = ranges.schema[low].dataType
    bin_ = lambda x, level: F.floor(x / F.pow(F.lit(2.0), level))
    binned = ranges.where(F.col(low) <= F.col(high)).withColumns({"__low": _place(F.col(low), kind), "__high": _place(F.col(high), ranges.schema[high].dataType)})
    binned = binned.withColumn("__level", _level(F.col("__low"), F.col("__high")))
    levels = sorted(r[0] for r in binned.select("__level").distinct().collect())  # powers of two: a hundred or so at most
    binned = binned.withColumn("__bin", F.explode(F.sequence(bin_(F.col("__low"), F.col("__level")), bin_(F.col("__high"), F.col("__level")))))
    spots = points.where(F.col(value).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    spots = spots.withColumn("__bin", bin_(_place(F.col(value), points.schema[value].dataType), F.col("__level")))
    x, r = spots.alias("x"), binned.alias("r")
    same = reduce(lambda p, q: p & q, [F.col(f"x.`{k}`") == F.col(f"r.`{k}`") for k in [*by, "__level", "__bin"]])
    return x.join(r, same & F.col(f"x.`{value}`").between(F.col(f"r.`{low}`"), F.col(f"r.`{high}`")) & (F.lit(True) if inside is None else inside))


def interval_join(x: DataFrame, y: DataFrame, by: list[str], x_from: str, x_to: str, y_from: str, y_to: str) -> DataFrame:
    """Pairs where the interval of ``x`` lies within that of ``y``, for equal keys, or of all rows if ``by`` is empty."""
    pairs = in_ranges(x, y, by, x_from, y_from, y_to, (F.col(f"x.`{x_to}`") <= F.col(f"r.`{y_to}`")) & (F.col(f"x.`{x_to}`") >= F.col(f"x.`{x_from}`")))
    return pairs.select(*[F.col(f"x.`{c}`") for c in x.columns], *[F.col(f"r.`{c}`") for c in y.columns if c not in x.columns])


def nest_join(x: DataFrame, y: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """``x`` with an array of its partners in ``y``, in the order of ``order``; empty without any."""
    rest = [*order, *[c for c in y.columns if c not in by and c not in order]]
    nested = y.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name))
    kind = nested.schema[name].dataType.simpleString()
    return x.join(nested, by, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def nest_join_between(x: DataFrame, y: DataFrame, by: list[str], low: str, high: str, value: str, name: str, order: list[str]) -> DataFrame:
    """``x`` with an array of the rows of ``y`` of equal ``by`` whose ``value`` lies between its ``low`` and ``high``, in the order of ``order``; empty without any.

    Each range is joined once, however many rows of ``x`` have it.
    """
    rest = [*order, *[c for c in y.columns if c not in by and c not in order]]
    span = [*by, low, high]
    pairs = in_ranges(y, x.select(*span).distinct(), by, value, low, high)
    nested = pairs.groupBy(*[F.col(f"r.`{c}`") for c in span]).agg(F.array_sort(F.collect_list(F.struct(*[F.col(f"x.`{c}`") for c in rest]))).alias(name))
    kind = nested.schema[name].dataType.simpleString()
    return x.join(nested, span, "left").select(*x.columns, F.coalesce(name, F.array().cast(kind)).alias(name))


def update_join(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """``x`` with the values of ``y`` where it has the key, nulls included; no rows are added."""
    new = y.select(*by, F.struct(*[c for c in y.columns if c not in by]).alias("__new"))
    values = [F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in y.columns and c not in by else F.col(c) for c in x.columns]
    return x.join(new, by, "left").select(*values)


def upsert(x: DataFrame, y: DataFrame, by: list[str]) -> DataFrame:
    """``update_join``, and the rows of ``y`` that ``x`` lacks."""
    return y.unionByName(anti_join(x, y, by))
