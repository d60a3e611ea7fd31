"""Archives built from streams of updates."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def compact_stream(updates: DataFrame, keys: list[str], value: str, time: str = "time_value", version: str = "version", tol: float = 0) -> DataFrame:
    """The compact archive of a stream of updates, with a column late.

    The state of an entity and time is its last value and version.  Rows that repeat
    the value are dropped; ``tol`` is for numbers, all else is compared as it stands.  Rows at a version not after the last are not applied;
    they come out with late true, as in batch they would be refused.
    """
    ekt = [*keys, time]
    kinds = {f.name: f.dataType.simpleString() for f in updates.schema.fields}
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in (*ekt, version))
    # Values travel as text, so that whole numbers and decimals of any length stay exact.
    numeric = isinstance(updates.schema[value].dataType, T.NumericType)
    told = updates.withColumn(value, F.col(value).cast("string"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, known, present = state.get if state.exists else (None, None, False)
        rows = pd.concat(list(batches)).sort_values(version, kind="stable")
        out = []
        for v, x in zip(rows[version], rows[value]):
            stamp, x = pd.Timestamp(v).isoformat() if not isinstance(v, (int, float)) else f"{int(v):020d}", None if pd.isna(x) or x == "NaN" else x
            if last is not None and stamp <= last:
                out.append((*key, v, x, True))
                continue
            same = present and (x == known or numeric and x is not None and known is not None and abs(Decimal(x) - Decimal(known)) <= Decimal(str(tol)))
            last, known, present = stamp, x, True
            if not same:
                out.append((*key, v, x, False))
        state.update((last, known, present))
        yield pd.DataFrame(out, columns=[*ekt, version, value, "late"])

    made = told.groupBy(*ekt).applyInPandasWithState(run, f"{columns}, `{value}` string, late boolean", "last string, known string, present boolean", "append", GroupStateTimeout.NoTimeout)
    return made.withColumn(value, F.col(value).cast(kinds[value]))


def windowed_counts(events: DataFrame, time: str, by: list[str], length: str, late: str) -> DataFrame:
    """Counts by window of event time; windows close when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")
