"""Values that occur more than once among all rows, by one shuffle of packed rows.

Each input row has an owner and a list of 64-bit values.  A task packs the values
of many owners that fall into one bucket into one row, so that a value costs about
as many bytes as it has.  Of a value that a task meets twice, only one mark is
sent, which counts as two: a value that a third of all owners hold reaches its
bucket once for each batch.  What is found goes back to the owners packed alike.

A Python worker holds one bucket at a time.  There are as many as keep it at some
``MOST_VALUES`` values, whatever the number of shuffle partitions is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronarch.llm.tables import buckets

#: Values of a bucket, about: some 300 MB while they are compared.
MOST_VALUES = 1 << 21

PACKED = "bucket int, known boolean, owners binary, counts binary, places binary, found binary"
FOUND = "owner long, places binary"


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.r_[at, len(x)]).astype(np.int32)


def _rows(bucket: np.ndarray, known: bool, owner: np.ndarray, place: np.ndarray, value: np.ndarray | None) -> list[dict]:
    order = np.argsort(bucket, kind="stable")
    names, sizes = _runs(bucket[order])
    out, at = [], 0
    for name, size in zip(names, sizes):
        take = order[at : at + size]
        at += size
        owners, counts = _runs(owner[take])
        out.append({"bucket": int(name), "known": known, "owners": owners.tobytes(), "counts": counts.tobytes(), "places": place[take].tobytes(), "found": b"" if value is None else value[take].tobytes()})
    return out


SCHEMA = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("owners", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()), ("found", pa.binary())])


def repeated(rows: DataFrame) -> DataFrame:
    """Of rows (owner long, values binary of uint64): owner and places (binary of int32, ascending) of those
    of its values that occur at least twice among all rows, twice in one row included.  Owners without such
    values have no row; an owner may stand in several rows, whose places then count in each row from 0.
    """
    # Few groups for each partition: every batch sends a row to each group.  More where a group would have too many values.
    total = rows.agg(F.sum(F.octet_length("values").cast("long"))).first()[0] or 0
    n = max(buckets(rows.sparkSession, 2), -(-total // (8 * MOST_VALUES)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(v, np.uint64) for v in batch["values"].to_pylist()]
            if not values:
                continue
            sizes = np.array([len(v) for v in values])
            value = np.concatenate(values)
            owner = np.repeat(batch["owner"].to_numpy(), sizes)
            place = (np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            _, first, inverse, count = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
            many = count[inverse] > 1
            marks = value[first[count > 1]]
            once = ~many
            out = _rows((value[once] % np.uint64(n)).astype(np.int32), False, owner[once], place[once], value[once])
            out += _rows((marks % np.uint64(n)).astype(np.int32), False, np.zeros(len(marks), np.int64), np.full(len(marks), -1, np.int32), marks)
            out += _rows((owner[many].astype(np.uint64) % np.uint64(n)).astype(np.int32), True, owner[many], place[many], None)
            if out:
                yield pa.RecordBatch.from_pylist(out, SCHEMA)

    def find(table: pa.Table) -> pa.Table:
        owners, places, values, out = [], [], [], []
        for row in table.to_pylist():
            if row["known"]:
                out.append({k: row[k] for k in ("owners", "counts", "places")} | {"bucket": row["bucket"]})
                continue
            owners.append(np.repeat(np.frombuffer(row["owners"], np.int64), np.frombuffer(row["counts"], np.int32)))
            places.append(np.frombuffer(row["places"], np.int32))
            values.append(np.frombuffer(row["found"], np.uint64))
        if values:
            owner, place, value = np.concatenate(owners), np.concatenate(places), np.concatenate(values)
            _, inverse, count = np.unique(value, return_inverse=True, return_counts=True)
            count = count + np.bincount(inverse, weights=place < 0, minlength=len(count))
            hit = (count[inverse] > 1) & (place >= 0)
            owner, place = owner[hit], place[hit]
            order = np.lexsort((place, owner))
            out += [{k: r[k] for k in ("bucket", "owners", "counts", "places")} for r in _rows((owner[order].astype(np.uint64) % np.uint64(n)).astype(np.int32), False, owner[order], place[order], None)]
        return pa.Table.from_pylist(out, pa.schema([SCHEMA.field(k) for k in ("bucket", "owners", "counts", "places")]))

    def give_back(table: pa.Table) -> pa.Table:
        owners, places = [], []
        for row in table.to_pylist():
            owners.append(np.repeat(np.frombuffer(row["owners"], np.int64), np.frombuffer(row["counts"], np.int32)))
            places.append(np.frombuffer(row["places"], np.int32))
        owner, place = (np.concatenate(owners), np.concatenate(places)) if owners else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.lexsort((place, owner))
        names, sizes = _runs(owner[order])
        ends = np.cumsum(sizes)
        place = place[order]
        return pa.table({"owner": pa.array(names, pa.int64()), "places": pa.array([place[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary())})

    packed = rows.select("owner", "values").mapInArrow(pack, PACKED)
    found = packed.groupBy("bucket").applyInArrow(find, "bucket int, owners binary, counts binary, places binary")
    return found.groupBy("bucket").applyInArrow(give_back, FOUND)
