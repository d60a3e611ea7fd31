"""Whole snapshots, one for each version, as a source that Spark reads version by version."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from chronarch.operators.changes import snapshots_to_archive

#: What lets Spark hand filters to a source in Python (fixed value: Spark's name of it).
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
HOLDS = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
}


class Version(InputPartition):
    """One snapshot: what one task loads."""


class SnapshotReader(DataSourceReader):
    """A partition for each version that all filters of versions let pass; such filters need no second look by Spark."""

    def __init__(self, load: Callable[[object], Iterator], versions: list, version: str, schema: T.StructType) -> None:
        self.load, self.versions, self.version, self.names = load, versions, version, [n for n in schema.names if n != version]
        self.place = schema.names.index(version)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == (self.version,) and type(f) in HOLDS and f.value is not None:
                self.versions = [v for v in self.versions if HOLDS[type(f)](v, f.value)]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [Version(v) for v in self.versions] or [Version(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        v = partition.value
        if v is None:  # every version is filtered out
            return
        for row in self.load(v):
            told = [row[n] for n in self.names] if isinstance(row, dict) else list(row)
            yield (*told[: self.place], v, *told[self.place :])


def snapshots(spark: SparkSession, versions: list, load: Callable[[object], Iterator], schema: str, version: str = "version") -> DataFrame:
    """The snapshots of all ``versions``, with a column of that name; filters of versions keep others from being loaded.

    ``load(version)`` runs in a task and gives that snapshot's rows, as dicts or as tuples in
    the order of ``schema`` (names and types without the version).  It may be asked again for a version, if
    an executor is lost.  A snapshot may be empty.
    """
    spark.conf.set(PUSHDOWN, "true")
    wanted = sorted(set(versions))
    kind = spark.createDataFrame([(v,) for v in wanted] or [(None,)], f"{version} long" if not wanted else [version]).schema[version].dataType
    whole = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField(version, kind)])
    title = f"snapshots_{uuid.uuid4().hex}"

    class Snapshots(DataSource):
        @classmethod
        def name(cls) -> str:
            return title

        def schema(self) -> T.StructType:
            return whole

        def reader(self, schema: T.StructType) -> SnapshotReader:
            return SnapshotReader(load, wanted, version, schema)

    spark.dataSource.register(Snapshots)
    df = spark.read.format(title).load()
    # Spark plans a source anew only where a filter reaches it, and else takes the partitions of the query before: one always does.
    return df.where(F.col(version) >= F.lit(wanted[0])) if wanted else df


def _within(versions: list, first, last) -> list:
    return [v for v in sorted(set(versions)) if (first is None or v >= first) and (last is None or v <= last)]


def load_archive(spark: SparkSession, versions: list, load: Callable[[object], Iterator], schema: str, ekt: list[str], first=None, last=None, tol: float = 0, version: str = "version") -> DataFrame:
    """The compact archive of the snapshots from ``first`` to ``last``, all if not given, deletions found.

    The bounds reach the source as filters.  A version whose snapshot is empty deletes all
    that was known before.
    """
    df = snapshots(spark, versions, load, schema, version)
    for bound, keep in ((first, F.col(version) >= F.lit(first)), (last, F.col(version) <= F.lit(last))):
        if bound is not None:
            df = df.where(keep)
    every = spark.createDataFrame([(v,) for v in _within(versions, first, last)], T.StructType([df.schema[version]]))
    return snapshots_to_archive(df, ekt, version, tol, every)


def snapshot_sizes(spark: SparkSession, versions: list, load: Callable[[object], Iterator], schema: str, version: str = "version") -> DataFrame:
    """(version, n): the rows of each snapshot, 0 where it is empty."""
    df = snapshots(spark, versions, load, schema, version)
    every = spark.createDataFrame([(v,) for v in sorted(set(versions))], T.StructType([df.schema[version]]))
    return every.join(df.groupBy(version).agg(F.count("*").alias("n")), version, "left").select(version, F.coalesce("n", F.lit(0)).alias("n"))
