"""Counts of hashed items over all documents, in a table of fixed size.

An item's count is that of its cell, so it is at least the true one.  Tasks send
cells in slices, which are added up slice by slice; what is broadcast has
``cells`` counts, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = 1 << 14


def counts(df: DataFrame, cells: int, items: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """int64 counts of ``items`` (arrays of uint64 hashes) modulo ``cells``, over all rows of ``df``."""

    def add_up(table: np.ndarray, held: list[np.ndarray]) -> None:
        if held:
            table += np.bincount((np.concatenate(held) % np.uint64(cells)).astype(np.int64), minlength=cells).astype(np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, np.int32)
        for batch in batches:
            held, n = [], 0
            for x in items(batch):
                held.append(x)
                n += len(x)
                if n > cells:
                    add_up(table, held)
                    held, n = [], 0
            add_up(table, held)
        for k in range(0, cells, SLICE):
            if table[k : k + SLICE].any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "c": pa.array([table[k : k + SLICE].tobytes()], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in t["c"].to_pylist())
        return pa.table({"k": t["k"][:1], "c": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(cells, np.int64)
    added = df.mapInArrow(count, "k long, c binary").groupBy("k").applyInArrow(add, "k long, c binary")
    for row in added.collect():  # cells counts in all
        part = np.frombuffer(row["c"], np.int64)
        out[row["k"] : row["k"] + len(part)] = part
    return out
