"""Contiguous shards of equal bytes, from prefix sums over all rows.

Rows are dealt into ranges of the order columns; each range is summed alone, the
totals of the ranges (a few numbers each) are summed up on top, and a running sum
within the range gives every row its global offset.  Cuts at equal targets of that
offset make the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronarch.llm.tables import Scratch, buckets, prepare, with_results, written


def assign_shards(df: DataFrame, size_col: str, order_by: str, n_shards: int, ties: list[str] | None = None) -> DataFrame:
    """All columns of ``df`` with shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 in each shard).

    Shards are contiguous in the order of ``order_by``, then of the columns ``ties``,
    then of all others that can be ordered, nulls first.  A row goes to the shard
    that holds the middle of its bytes, so a shard differs from the mean by no more
    than the size of the rows at its two ends.  A null size counts as 0.  Rows equal
    in all columns are interchangeable.  If all sizes are 0, all rows go to shard 0.
    Input columns named shard or slot are replaced.  No rows: no rows.
    """
    prepare(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    others = [c for c in df.columns if c not in (order_by, *(ties or [])) and not any(x in dict(df.dtypes)[c] for x in ("map", "variant"))]
    order = [F.col(f"`{c}`").asc_nulls_first() for c in (order_by, *(ties or []), *others)]
    sized = df.withColumn("__size", F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)))
    # The number of a row's range is kept with the row, so both passes below see the same ranges.
    sized = sized.repartitionByRange(buckets(df.sparkSession), *order).withColumn("__range", F.spark_partition_id())
    sized = scratch.written(sized, "sized")
    totals = sized.groupBy("__range").agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows"))
    before, before_rows, at, starts = 0, 0, {}, []
    for row in sorted(totals.collect()):  # a row for each range
        at[row["__range"]] = (before, before_rows)
        before, before_rows = before + row["bytes"], before_rows + row["rows"]
    starts = df.sparkSession.createDataFrame([(k, *v) for k, v in at.items()], "__range int, __bytes long, __rows long")

    within = Window.partitionBy("__range").orderBy(*order)
    rows = sized.join(F.broadcast(starts), "__range")
    rows = rows.withColumn("__row", F.col("__rows") + F.row_number().over(within) - 1)
    rows = rows.withColumn("__end", F.col("__bytes") + F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    middle = F.col("__end").cast("decimal(38,0)") * 2 - F.col("__size")
    rows = rows.withColumn("__shard", F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(1, 2 * before)).cast("decimal(38,0)"))).cast("int"))
    rows = written(rows.drop("__bytes", "__rows", "__end", "__size", "__range"), "sharded")
    scratch.close()
    first = rows.groupBy("__shard").agg(F.min("__row").alias("__first"))  # a row for each shard
    rows = rows.join(F.broadcast(first), "__shard")
    return with_results(rows, {"shard": F.col("__shard"), "slot": F.col("__row") - F.col("__first")}).drop("__shard", "__row", "__first")


def write_shards(df: DataFrame, path: str, **how) -> None:
    """Write the rows of ``assign_shards``, a folder shard=N for each shard, in order."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, **how)
