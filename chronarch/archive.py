"""Versioned time series: what was reported of which time, and when it was reported.

An archive has a row for each entity (``keys``), time and version at which values
changed.  A value holds until the next version of its entity and time.  A row whose
values are all null is a deletion.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronarch.functions.equality import nan_to_null
from chronarch.functions.steps import UNITS


#: A version before all others, by type.
LEAST = {"date": "DATE'0001-01-01'", "timestamp": "TIMESTAMP'0001-01-01 00:00:00'", "timestamp_ntz": "TIMESTAMP_NTZ'0001-01-01 00:00:00'", "integer": "-2147483648", "long": "-9223372036854775808L"}


class DuplicateKeys(ValueError):
    """An entity, time and version stands in more than one row."""


@dataclass(frozen=True)
class Archive:
    df: DataFrame
    keys: tuple[str, ...] = ("geo_value",)
    time_type: str = "day"
    versions_end: date | int | None = None
    clobberable_versions_start: date | int | None = None
    time: str = "time_value"
    version: str = "version"

    def __post_init__(self) -> None:
        if self.time_type not in UNITS:
            raise ValueError(f"time_type must be one of {sorted(UNITS)}")
        if missing := [c for c in (*self.ekt, self.version) if c not in self.df.columns]:
            raise ValueError(f"columns are missing: {missing}")

    @property
    def ekt(self) -> list[str]:
        """Entity and time: the key of a snapshot."""
        return [*self.keys, self.time]

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in (*self.ekt, self.version)]

    def of(self, df: DataFrame, **changes) -> Archive:
        return replace(self, df=df, **changes)

    def where(self, condition) -> Archive:
        """Rows by their keys, times, or versions up to one; a filter of values would break what holds until when.

        A lower bound of versions would lose rows that still hold: where a row passes
        that wouldn't at the least version, reading the result is an error.  ``since`` has such rows.
        """
        kept = self.df.where(condition)  # tells of names that there are not
        told = F.expr(condition) if isinstance(condition, str) else condition
        try:
            _ = self.df.drop(*self.values).select(told).schema
        except AnalysisException as e:
            raise ValueError("archives are filtered by keys, times and versions only") from e
        if re.search(rf"\b{re.escape(self.version)}\b", str(told)):  # it looks at versions, or seems to
            kind = self.df.schema[self.version].dataType
            least = F.expr(LEAST[kind.typeName()]).cast(kind) if kind.typeName() in LEAST else F.col(self.version)
            held = kept.withColumns({"__own": F.col(self.version), self.version: least})
            upto = F.when(told, True).otherwise(F.raise_error(F.lit("an archive's filter can't have a lower bound of versions: rows that still hold would be lost")).cast("boolean"))
            kept = held.where(upto).withColumn(self.version, F.col("__own")).select(self.df.columns)
        return self.of(kept)

    def since(self, version) -> Archive:
        """What is known from ``version`` on: its later rows, and the newest before, which hold then, as if published at ``version``."""
        v = F.col(self.version)
        old = self.df.where(v <= F.lit(version)).groupBy(*self.ekt).agg(F.max_by(F.struct(*self.values), v).alias("__s"))
        kind = self.df.schema[self.version].dataType
        held = old.select(*self.ekt, F.lit(version).cast(kind).alias(self.version), "__s.*")
        return self.of(self.df.where(v > F.lit(version)).unionByName(held))

    def final(self) -> DataFrame:
        """Rows of versions that will not be rewritten."""
        return self.df if self.clobberable_versions_start is None else self.df.where(F.col(self.version) < F.lit(self.clobberable_versions_start))

    def open(self) -> DataFrame:
        """Rows of versions that may yet be rewritten."""
        return self.df.where(F.lit(False) if self.clobberable_versions_start is None else F.col(self.version) >= F.lit(self.clobberable_versions_start))


@dataclass(frozen=True)
class Snapshot:
    """The rows known at the version ``as_of``, one for each entity and time."""

    df: DataFrame
    as_of: date | int
    keys: tuple[str, ...] = ("geo_value",)
    time: str = "time_value"

    def __post_init__(self) -> None:
        if "version" in self.df.columns:
            raise ValueError("a snapshot has no column named version")

    @property
    def ekt(self) -> list[str]:
        return [*self.keys, self.time]


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys in more than one row; counts are summed up before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def as_archive(df: DataFrame, keys: tuple[str, ...] = ("geo_value",), compact: bool = True, tol: float = 0, check: bool = True, **how) -> Archive:
    """An archive of ``df``: NaN becomes null, keys are checked, and rows that repeat what was known go."""
    from chronarch.operators.compaction import compactify

    archive = Archive(df, keys, **how)
    archive = archive.of(nan_to_null(df, archive.values))
    if check and not duplicate_keys(archive.df, [*archive.ekt, archive.version]).isEmpty():
        raise DuplicateKeys("entity, time and version must be unique")
    if archive.versions_end is not None:
        last = archive.df.agg(F.max(archive.version)).first()[0]
        if last is not None and last > archive.versions_end:
            raise ValueError("versions_end is before the last version")
    return archive.of(compactify(archive.df, archive.ekt, archive.version, tol)) if compact else archive
