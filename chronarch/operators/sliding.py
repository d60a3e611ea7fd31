"""Windows that slide over time: in a snapshot, and in an archive at every version.

Times are a regular grid.  A gap or a null within the window gives null, and
results stand only at times of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronarch.archive import Archive
from chronarch.functions.steps import Window, slide_names, step, window
from chronarch.operators.compaction import compactify
from chronarch.operators.travel import as_of_each


@dataclass(frozen=True)
class SlideFunction:
    make: Callable[[Column], Column]
    short: str  #: in names, for numbers
    short_logical: str  #: in names, for booleans
    additive: bool = False



#: The functions that may slide (fixed values: names and their short forms).
FUNCTIONS = {
    "sum": SlideFunction(F.sum, "sum", "count", True),
    "mean": SlideFunction(F.avg, "av", "prop", True),
    "prod": SlideFunction(lambda c: F.product(c.cast("double")), "prod", "prod"),
    "min": SlideFunction(F.min, "min", "min"),
    "max": SlideFunction(F.max, "max", "max"),
    "all": SlideFunction(F.bool_and, "all", "all"),
    "any": SlideFunction(F.bool_or, "any", "any"),
}


def slide_function(name: str) -> SlideFunction:
    if name not in FUNCTIONS:
        raise ValueError(f"{name} cannot slide; one of {sorted(FUNCTIONS)} can")
    return FUNCTIONS[name]


def _names(df: DataFrame, columns: list[str], f: SlideFunction, size: float, align: str, time_type: str, **naming) -> list[str]:
    """Each column is named by its own type: sums of booleans are counts, their means proportions."""
    shorts = [f.short_logical if isinstance(df.schema[c].dataType, T.BooleanType) else f.short for c in columns]
    return slide_names(columns, df.columns, shorts, size, align, time_type, **naming)


def _operand(df: DataFrame, column: str, name: str) -> Column:
    """Sums and means of booleans are counts and proportions."""
    logical = isinstance(df.schema[column].dataType, T.BooleanType)
    return F.col(column).cast("long") if logical and name in ("sum", "mean") else F.col(column)


def slide(df: DataFrame, keys: list[str], columns: list[str], f: str = "mean", size: float = 7, align: str = "right", time: str = "time_value", time_type: str = "day", **naming) -> DataFrame:
    """``df`` with a sliding ``f`` of each column, named such as x_7dav.  One shuffle by ``keys`` serves all columns."""
    how, win = slide_function(f), window(size, align)
    new = _names(df, columns, how, size, align, time_type, **naming)
    rows = df.withColumn("__t", step(F.col(time), time_type))
    by = W.partitionBy(*keys).orderBy("__t")
    frame = by.rangeBetween(W.unboundedPreceding, 0) if win.before is None else by.rangeBetween(-win.before, win.after)
    full = F.lit(win.size) if win.size else F.col("__t") - F.min("__t").over(frame) + 1
    made = {}
    for c, n in zip(columns, new):
        x = _operand(df, c, f)
        made[n] = F.when(F.count(c).over(frame) == full, how.make(x).over(frame))
    return rows.select(*df.columns, *[x.alias(n) for n, x in made.items()])


def slide_apply(df: DataFrame, keys: list[str], column: str, f: Callable[[list[float]], float], size: int, align: str = "right", name: str = "slide_value", time: str = "time_value", time_type: str = "day") -> DataFrame:
    """``df`` with any function of each whole window's values, in time order; Spark collects the windows, Python batches of rows call ``f``."""
    win = window(size, align)
    rows = df.withColumn("__t", step(F.col(time), time_type))
    frame = W.partitionBy(*keys).orderBy("__t").rangeBetween(-win.before, win.after)
    rows = rows.withColumn("__w", F.transform(F.array_sort(F.collect_list(F.struct("__t", F.col(column).cast("double").alias("x"))).over(frame)), lambda r: r["x"]))
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    full = F.when(F.size(F.filter("__w", lambda x: x.isNotNull())) == win.size, F.col("__w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if w is None else float(f(w)) for w in batch["__w"].to_pylist()]
            yield batch.drop_columns(["__w"]).append_column(name, pa.array(made, pa.float64()))

    return rows.select(*df.columns, full.alias("__w")).mapInArrow(run, f"{fields}, `{name}` double")


def _delta_slide(archive: Archive, columns: list[str], f: str, win: Window, names: list[str]) -> DataFrame:
    """Changes of values are spread over the windows that hold them and summed up over versions: no join.

    Each change costs as many rows as the window is wide, for all columns together;
    they are summed up before the shuffle.
    """
    v, t = archive.version, "__t"
    rows, changes = _deltas(archive, columns, f)
    spread = rows.select(*archive.keys, v, *changes, F.col(archive.time).alias("__own"), t, F.explode(F.sequence(F.lit(-win.after), F.lit(win.before))).alias("__k"))
    spread = spread.withColumn("__at", F.col(t) + F.col("__k"))
    summed = spread.groupBy(*archive.keys, "__at", v).agg(*[F.sum(c).alias(c) for c in changes], F.max(F.when(F.col("__k") == 0, F.col("__own"))).alias("__own"))
    run = W.partitionBy(*archive.keys, "__at").orderBy(v).rowsBetween(W.unboundedPreceding, 0)
    told = summed.select(*archive.keys, v, F.max("__own").over(run).alias(archive.time), *[F.sum(c).over(run).alias(c) for c in changes])
    values = [F.when(F.col(f"__dn{k}") == win.size, F.col(f"__dx{k}") / win.size if f == "mean" else F.col(f"__dx{k}")).alias(n) for k, n in enumerate(names)]
    return told.where(F.col(archive.time).isNotNull()).select(*archive.ekt, v, *values)


def _deltas(archive: Archive, columns: list[str], f: str) -> tuple[DataFrame, list[str]]:
    """Rows with __t and, for each column k, by how much its value (__dxk) and its number of values (__dnk) change there."""
    v, t = archive.version, "__t"
    by = W.partitionBy(*archive.keys, t).orderBy(v)
    x = [_operand(archive.df, c, f).alias(f"__x{k}") for k, c in enumerate(columns)]
    rows = archive.df.select(*archive.keys, archive.time, step(F.col(archive.time), archive.time_type).cast("long").alias(t), v, *x)
    changes = {}
    for k in range(len(columns)):
        now, before = F.col(f"__x{k}"), F.lag(f"__x{k}").over(by)
        changes |= {f"__dx{k}": F.coalesce(now, F.lit(0)) - F.coalesce(before, F.lit(0)), f"__dn{k}": now.isNotNull().cast("long") - before.isNotNull().cast("long")}
    return rows.withColumns(changes), list(changes)


def _running_slide(archive: Archive, columns: list[str], f: str, names: list[str]) -> DataFrame:
    """Sums and means of all times up to each, at every version: a sum over all changes at earlier times and versions.

    Times fall into blocks of 1, 2, 4, ... steps.  A change counts in the blocks that hold it,
    each of which keeps running sums over versions; the times up to t are as many blocks as
    t has bits.  So a change and a result each cost rows by the logarithm of the time's extent.
    Results stand at times from the first that a version changes on, where the sums may differ.
    """
    v, t, keys = archive.version, "__t", list(archive.keys)
    rows, changes = _deltas(archive, columns, f)
    extent = rows.groupBy(*keys).agg(F.min(t).alias("__t0"), (F.max(t) - F.min(t) + 1).alias("__extent"))
    cells = rows.groupBy(*keys, t).agg(F.min(v).alias("__first"), F.first(archive.time).alias(archive.time))
    run = W.partitionBy(*keys).orderBy(v).rowsBetween(W.unboundedPreceding, 0)
    updates = rows.groupBy(*keys, v).agg(F.min(t).alias("__low"), F.max(t).alias("__high"))
    updates = updates.withColumns({"__begin": F.min("__low").over(run), "__end": F.max("__high").over(run)})
    results = updates.select(*keys, v, "__begin", F.explode(F.sequence("__low", "__end")).alias(t)).join(cells, [*keys, t]).where(F.col("__first") <= F.col(v))

    place = F.col(t) - F.col("__t0")
    levels = "sequence(0, length(bin(__extent)) - 1)"
    block = lambda n, held: F.expr(f"transform(filter({levels}, k -> (shiftright({n}, k) & 1) = {held}), k -> struct(k AS level, shiftright({n}, k) - {held} AS number))")
    sources = rows.join(extent, keys).withColumn("__p", place).select(*keys, v, *changes, F.lit(None).cast("long").alias(t), F.explode(block("__p", 0)).alias("__b"))
    asked = results.join(extent, keys).withColumn("__p", place + 1).select(*keys, v, *[F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in changes], t, F.explode(block("__p", 1)).alias("__b"))
    upto = W.partitionBy(*keys, "__b").orderBy(v).rangeBetween(W.unboundedPreceding, 0)
    parts = sources.union(asked).select(*keys, v, t, *[F.sum(c).over(upto).alias(c) for c in changes]).where(F.col(t).isNotNull())
    told = parts.groupBy(*keys, t, v).agg(*[F.sum(c).alias(c) for c in changes]).join(results.select(*keys, t, v, archive.time, "__begin"), [*keys, t, v])
    size = F.col(t) - F.col("__begin") + 1
    kinds = [archive.df.schema[c].dataType for c in columns]
    value = lambda k: F.col(f"__dx{k}") / size if f == "mean" else F.col(f"__dx{k}").cast("long") if isinstance(kinds[k], (T.IntegralType, T.BooleanType)) else F.col(f"__dx{k}")
    return told.select(*archive.ekt, v, *[F.when(F.col(f"__dn{k}") == size, value(k)).alias(n) for k, n in enumerate(names)])


#: How the parts of a window that lie in two blocks make one (sums of means are divided at the end).
_JOINED = {
    "sum": lambda a, b: a + b, "mean": lambda a, b: a + b, "prod": lambda a, b: a * b, "min": F.least, "max": F.greatest,
    "all": lambda a, b: a & b, "any": lambda a, b: a | b,
}


def _block_slide(archive: Archive, columns: list[str], f: str, win: Window, names: list[str]) -> DataFrame:
    """Windows at every version from blocks of times as long as the window.

    A window is the end of one block and the beginning of the next.  Where a version changes
    a block, the function of all its beginnings and ends is worked out anew, from the rows
    that hold then; a window joins the two that were last worked out.  So a changed block
    costs rows in proportion to the window's length, and a window reads two of them.
    """
    how, v, t, keys, n = slide_function(f), archive.version, "__t", list(archive.keys), win.size
    make = F.sum if f == "mean" else how.make
    x = {f"__x{k}": _operand(archive.df, c, f) for k, c in enumerate(columns)}
    rows = archive.df.select(*keys, archive.time, step(F.col(archive.time), archive.time_type).cast("long").alias(t), F.col(v), *[c.alias(a) for a, c in x.items()])
    first = rows.groupBy(*keys, t).agg(F.min(v).alias("__first"), F.first(archive.time).alias(archive.time))

    # Each row is dealt to the versions of its block, by their ranks, at which it holds.
    block = [*keys, "__b"]
    ranked = rows.withColumn("__b", F.floor(F.col(t) / n)).withColumn("__rank", F.dense_rank().over(W.partitionBy(*block).orderBy(v)))
    ranked = ranked.withColumns({"__next": F.lead("__rank").over(W.partitionBy(*block, t).orderBy(v)), "__most": F.max("__rank").over(W.partitionBy(*block))})
    held = ranked.select(*block, t, v, "__rank", *x, F.explode(F.sequence(F.col("__rank"), F.coalesce(F.col("__next") - 1, F.col("__most")))).alias("__at"))
    state = W.partitionBy(*block, "__at")
    before, after = state.orderBy(t).rowsBetween(W.unboundedPreceding, 0), state.orderBy(t).rowsBetween(0, W.unboundedFollowing)
    part = lambda frame: F.struct(*[F.count(c).over(frame).alias(f"n{c}") for c in x], *[make(F.col(c)).over(frame).alias(c) for c in x])
    cells = held.select(*block, t, F.max(F.when(F.col("__rank") == F.col("__at"), F.col(v))).over(state).alias(v), part(before).alias("__head"), part(after).alias("__tail"))

    # The end of a block from t on opens the window that begins at t; the beginning up to t closes the one that ends there.
    none = F.lit(None).cast(cells.schema["__head"].dataType)
    opened = cells.select(*keys, (F.col(t) + win.before).alias(t), v, F.col("__tail").alias("__open"), none.alias("__close"))
    closed = cells.where(F.pmod(F.col(t), F.lit(n)) != n - 1).select(*keys, (F.col(t) - win.after).alias(t), v, none.alias("__open"), F.col("__head").alias("__close"))
    alone = first.select(*keys, t, F.col("__first").alias(v), none.alias("__open"), none.alias("__close"))
    both = opened.union(closed).union(alone).groupBy(*keys, t, v).agg(*[F.max(c).alias(c) for c in ("__open", "__close")])
    upto = W.partitionBy(*keys, t).orderBy(v).rowsBetween(W.unboundedPreceding, 0)
    last = both.select(*keys, t, v, *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("__open", "__close")])
    made = last.join(first, [*keys, t]).where(F.col("__first") <= F.col(v))

    def value(c: str, name: str) -> Column:
        a, b = F.col(f"__open.{c}"), F.col(f"__close.{c}")
        many = F.coalesce(F.col(f"__open.n{c}"), F.lit(0)) + F.coalesce(F.col(f"__close.n{c}"), F.lit(0))
        whole = F.when(F.col("__close").isNull() | (F.col(f"__open.n{c}") == n), a).otherwise(_JOINED[f](a, b))
        return F.when(many == n, whole / n if f == "mean" else whole).alias(name)

    return made.select(*archive.ekt, v, *[value(c, name) for c, name in zip(x, names)])


def archive_slide(archive: Archive, columns: str | list[str], f: str = "mean", size: float = 7, align: str = "right", form: str | None = None, tol: float = 0, groups: list[str] | None = None, **naming) -> Archive:
    """The archive of a sliding ``f`` of each column at every version, without computing every snapshot.

    form "delta" sums changes (sum and mean), form "asof" recomputes touched windows
    (all functions).  By default whole numbers take delta and others asof, as sums
    of rounded changes would seem to change.  ``size`` inf takes all times from the
    first that was known on; its form "asof" makes every snapshot, so that form is for
    few versions.  ``groups``, if given, must be all keys: windows never cross entities.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    if groups is not None and set(groups) != set(archive.keys):
        raise ValueError(f"an archive slides within its entities: group by all of {list(archive.keys)}")
    how, win = slide_function(f), window(size, align)
    names = _names(archive.df, columns, how, size, align, archive.time_type, **naming)
    whole = all(isinstance(archive.df.schema[c].dataType, (T.IntegralType, T.DecimalType, T.BooleanType)) for c in columns)
    form = form or ("delta" if how.additive and whole else "asof")
    if form == "delta" and not how.additive:
        raise ValueError(f"{f} has no delta form")
    if win.size is None and form == "delta":
        made = _running_slide(archive, columns, f, names)
    elif win.size is None:
        each = as_of_each(archive)
        made = slide(each, [*archive.keys, archive.version], columns, f, size, align, archive.time, archive.time_type, new_names=names).select(*archive.ekt, archive.version, *names)
    else:
        made = (_delta_slide if form == "delta" else _block_slide)(archive, columns, f, win, names)
    return archive.of(compactify(made, archive.ekt, archive.version, tol))


def archive_slide_apply(archive: Archive, column: str, f: Callable[[list[float]], float], size: int, align: str = "right", name: str = "slide_value", tol: float = 0) -> Archive:
    """``archive_slide`` of any function of a whole window's values, in one task for each entity."""
    win = window(size, align)
    valid = archive.df.select(*archive.ekt, archive.version, step(F.col(archive.time), archive.time_type).alias("__t"), F.col(column).cast("double").alias("__x"))
    keys, time, version = list(archive.keys), archive.time, archive.version
    kinds = {x.name: x.dataType.simpleString() for x in archive.df.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*archive.ekt, version)) + f", `{name}` double"

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        now: dict[int, tuple] = {}
        out = []
        for v, update in rows.sort_values(version).groupby(version, sort=True):
            touched = set()
            for t, own, x in zip(update["__t"], update[time], update["__x"]):
                now[t] = (own, x)
                touched.update(range(t - win.after, t + win.before + 1))
            for t in sorted(touched & now.keys()):
                part = [now[s][1] for s in range(t - win.before, t + win.after + 1) if s in now and pd.notna(now[s][1])]
                out.append((*key, now[t][0], v, f(part) if len(part) == win.size else None))
        return pd.DataFrame(out, columns=[*keys, time, version, name])

    made = valid.groupBy(*keys).applyInPandas(fold, schema)
    return archive.of(compactify(made, archive.ekt, version, tol))
