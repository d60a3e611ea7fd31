"""Windows that slide over a stream of updates, with results at every version as in batch."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from decimal import Decimal
from math import prod

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from chronarch.functions.steps import Window, step, window
from chronarch.operators.sliding import _names, slide_function

#: Maps in state need this store (fixed value: Spark's name of it).
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FUNCTIONS = {"sum": sum, "mean": lambda x: sum(x) / len(x), "min": min, "max": max, "prod": lambda x: float(prod(x)), "all": all, "any": any}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state in RocksDB, on the executors' disks and in the checkpoint."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def _result(kind: T.DataType, f: str) -> str:
    if f in ("mean", "prod"):
        return "double"
    if f == "sum":
        return "long" if isinstance(kind, (T.IntegralType, T.BooleanType)) else f"decimal(38,{kind.scale})" if isinstance(kind, T.DecimalType) else "double"
    return kind.simpleString()


def _reader(kind: T.DataType):
    """From the text of a value to the value."""
    if isinstance(kind, T.BooleanType):
        return lambda x: x == "true"
    return int if isinstance(kind, T.IntegralType) else Decimal if isinstance(kind, T.DecimalType) else float


class SlideProcessor(StatefulProcessor):
    """The latest values of one entity, by time, and what was last told of their windows.

    Values travel as text, so that numbers of any length stay exact.  Names don't begin with an
    underscore, as those are lost on the way to Python.
    """

    def __init__(self, keys: list[str], kinds: list[T.DataType], f: str, win: Window, lag: int) -> None:
        self.keys, self.f, self.win, self.lag, self.many = keys, f, win, lag, len(kinds)
        self.kinds = kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ", ".join(f"{c}{k} string" for c in "xy" for k in range(self.many))
        self.cells = handle.getMapState("cells", "t long", f"version long, time string, told boolean, {fields}")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, win = self.many, self.win
        read, make = [_reader(k) for k in self.kinds], FUNCTIONS[self.f]
        cells = {int(k[0]): list(v) for k, v in self.cells.iterator()}
        newest, changed, out = max(cells, default=None), set(), []
        part = pd.concat(list(rows)).sort_values(["slide_order", "slide_t"], kind="stable")
        values = [[None if pd.isna(x) or x == "NaN" else x for x in part[f"slide_x{k}"]] for k in range(n)]
        updates = list(zip(part["slide_order"].tolist(), part["slide_t"].tolist(), part["slide_time"], part["slide_version"], zip(*values)))
        at = 0
        while at < len(updates):
            order, version = updates[at][0], updates[at][3]
            touched, known = set(), newest
            while at < len(updates) and updates[at][0] == order:
                _, t, time, _, x = updates[at]
                at += 1
                if known is not None and t < known - self.lag or t in cells and order <= cells[t][0]:
                    out.append((*key, time, version, *[None] * n, True))
                    continue
                cells[t] = [order, time, cells[t][2] if t in cells else False, *x, *(cells[t][3 + n :] if t in cells else [None] * n)]
                newest = t if newest is None else max(newest, t)
                changed.add(t)
                touched.update(range(t - win.after, t + win.before + 1))
            for t in sorted(touched & cells.keys()):
                made = []
                for k in range(n):
                    own = [cells[s][3 + k] for s in range(t - win.before, t + win.after + 1) if s in cells]
                    full = len(own) == win.size and all(x is not None for x in own)
                    y = make([read[k](x) for x in own]) if full else None
                    made.append(None if y is None else str(y).lower() if isinstance(y, bool) else str(y))
                if not cells[t][2] or made != cells[t][3 + n :]:
                    cells[t][2:] = [True, *cells[t][3 : 3 + n], *made]
                    changed.add(t)
                    out.append((*key, cells[t][1], version, *made, False))
        for t in [t for t in cells if t < newest - self.lag - win.size + 1]:
            changed.discard(t)
            self.cells.removeKey((t,))
        for t in changed:
            self.cells.updateValue((t,), tuple(cells[t]))
        yield pd.DataFrame(out, columns=[*self.keys, "slide_time", "slide_version", *[f"slide_y{k}" for k in range(n)], "late"], dtype=object).astype({"late": bool})


def _order(version: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.unix_date(version).cast("long")
    return F.unix_micros(version) if isinstance(kind, T.TimestampType) else version.cast("long")


def slide_stream(updates: DataFrame, keys: list[str], columns: list[str], f: str = "sum", size: int = 7, align: str = "right", lag: int = 30, time: str = "time_value", version: str = "version", time_type: str = "day", **naming) -> DataFrame:
    """The compact archive of a sliding ``f`` of each column over a stream of updates, with a column late.

    Rows equal those of ``archive_slide`` if updates come by ascending version.  A row that
    is over ``lag`` steps older than its entity's newest time of earlier versions, or not newer
    than what is known of its time, is not applied and comes out with late true.  The state
    of an entity is at most ``lag`` + ``size`` times with their values, whatever it has seen.
    Start the query within ``state_store``.
    """
    how, win = slide_function(f), window(size, align)
    if win.size is None:
        raise ValueError("a window without end would keep every time in state")
    names = _names(updates, columns, how, size, align, time_type, **naming)
    kinds = {x.name: x.dataType for x in updates.schema.fields}
    long = lambda c: F.col(c).cast("long") if isinstance(kinds[c], T.BooleanType) and f in ("sum", "mean") else F.col(c)
    rows = updates.select(
        *keys, step(F.col(time), time_type).cast("long").alias("slide_t"), F.col(time).cast("string").alias("slide_time"), _order(F.col(version), kinds[version]).alias("slide_order"),
        F.col(version).cast("string").alias("slide_version"), *[long(c).cast("string").alias(f"slide_x{k}") for k, c in enumerate(columns)],
    )
    own = [T.LongType() if isinstance(kinds[c], T.BooleanType) and f in ("sum", "mean") else kinds[c] for c in columns]
    schema = "".join(f"`{c}` {kinds[c].simpleString()}, " for c in keys) + "slide_time string, slide_version string, " + "".join(f"slide_y{k} string, " for k in range(len(columns))) + "late boolean"
    made = rows.groupBy(*keys).transformWithStateInPandas(SlideProcessor(keys, own, f, win, lag), schema, "Update", "None")
    return made.select(*keys, F.col("slide_time").cast(kinds[time]).alias(time), F.col("slide_version").cast(kinds[version]).alias(version), *[F.col(f"slide_y{k}").cast(_result(kinds[c], f)).alias(name) for k, (c, name) in enumerate(zip(columns, names))], "late")
