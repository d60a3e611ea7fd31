"""Tables written on the way, and sizes read from the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once, where the session leaves Spark's own number: whole texts are long rows.
BATCH_KEY, SPARK_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "512"
#: How Python workers get memory: from the system, which takes it back, and for all threads together.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1"}


def prepare(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; settings that a user has made stay."""
    if spark.conf.get(BATCH_KEY) == SPARK_BATCH:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Where that is unset, a local session, as in tests, gets one of its own; a cluster is told."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chronarch-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def path_of(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one computation in the shared folder, removed when its result is written or with ``close``."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a Parquet table: work done once, which survives lost executors."""
        path = path_of(self.spark, name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (path, table)
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing will read again."""
        for t in tables:
            path, _ = self.paths.pop(id(t), (None, None))
            if path:
                remove(self.spark, path)

    def close(self) -> None:
        self.drop(*[t for _, t in list(self.paths.values())])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder that stays, as a result reads it."""
    return Scratch(df.sparkSession).written(df, name)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder, for small tables of an iteration."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def buckets(spark: SparkSession, each: int = 8) -> int:
    """Number of groups into which rows are dealt: ``each`` for a shuffle partition, so that they even out."""
    return each * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bits(values: DataFrame, column: str, size: int) -> bytes:
    """A table of ``size`` bits, those set that the hashed column's values fall on modulo ``size``; tasks send parts of it, merged by Spark."""
    cell = F.pmod(F.col(column), F.lit(size)) + 1  # Spark counts positions from 1
    parts = values.groupBy(F.bitmap_bucket_number(cell).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
    out = bytearray(max(size // 8, 1) + 8192)
    for row in parts.collect():  # size / 8 bytes in all
        at = 4096 * (row["part"] - 1)
        out[at : at + len(row["bits"])] = row["bits"]
    return bytes(out)


def with_results(df: DataFrame, results: dict) -> DataFrame:
    """``df`` with result columns, which take the place of columns of the same name in any letter case."""
    names = {n.lower() for n in results}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in results.items()])


def text_key(column: Column) -> Column:
    """64-bit key of a text; null counts as the empty text."""
    return F.xxhash64(F.coalesce(column, F.lit("")))
