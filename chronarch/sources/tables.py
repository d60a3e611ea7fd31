"""Archives and snapshots in files."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronarch.archive import Archive, DuplicateKeys, duplicate_keys
from chronarch.functions.equality import nan_to_null
from chronarch.functions.steps import shifted
from chronarch.operators.compaction import is_repeat


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What an archive's folder says of it beside its rows; Spark's readers pass over such names.
NOTES = "_archive.json"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _noted(spark: SparkSession, path: str) -> dict:
    at, fs = _files(spark, f"{path}/{NOTES}")
    if not fs.exists(at):
        return {}
    stream = fs.open(at)
    try:
        told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    for name in ("versions_end", "clobberable_versions_start"):
        if isinstance(told[name], str):
            told[name] = date.fromisoformat(told[name])
    return told | {"keys": tuple(told["keys"])}


def _note(archive: Archive, path: str) -> None:
    """Write the archive's notes; the file is made whole under another name and then takes its own."""
    spark = archive.df.sparkSession
    plain = lambda x: x.isoformat() if isinstance(x, date) else x
    told = {n: plain(getattr(archive, n)) for n in ("keys", "time_type", "time", "version", "versions_end", "clobberable_versions_start")}
    told["schema"] = archive.df.schema.jsonValue()
    draft, fs = _files(spark, f"{path}/{NOTES}.{uuid.uuid4().hex}")
    stream = fs.create(draft)
    stream.write(bytearray(json.dumps(told).encode()))
    stream.close()
    at = _files(spark, f"{path}/{NOTES}")[0]
    fs.delete(at, False)
    fs.rename(draft, at)


def read_archive(spark: SparkSession, path: str, versions: tuple | None = None, times: tuple | None = None, fmt: str = "parquet", **how) -> Archive:
    """The archive at ``path``, as ``write_archive`` noted it or as ``how`` says; ranges (first, last) of versions and times, both inclusive, reach the scan.

    Versions before the range are needed to tell what was known within it, so a
    range of versions gives the updates of that range only.
    """
    told = _noted(spark, path)
    schema = told.pop("schema", None)
    reader = spark.read.format(fmt)
    if schema:
        kind = T.StructType.fromJson(schema)
        df = reader.schema(kind).load(path).select(kind.names)
    else:
        df = reader.load(path)
    archive = Archive(df, **told | how)
    for column, range_ in ((archive.version, versions), (archive.time, times)):
        if range_ is not None:
            archive = archive.of(archive.df.where(F.col(column).between(*[F.lit(x) for x in range_])))
    return archive


def write_archive(archive: Archive, path: str, partition_by: list[str] | None = None, mode: str = "error", fmt: str = "parquet") -> None:
    """Write by version (or ``partition_by``), so that a new version adds a folder and readers of a range pass over the others."""
    by = partition_by or [archive.version]
    archive.df.repartition(*by, *archive.keys).write.format(fmt).mode(mode).partitionBy(*by).save(path)
    _note(archive, path)


def rewrite_tail(spark: SparkSession, path: str, tail: DataFrame, start, versions_end=None, clobberable_versions_start=None, tol: float = 0, fmt: str = "parquet") -> Archive:
    """Put ``tail`` in place of all versions from ``start`` on in the archive at ``path``, written by version.

    Only open versions can be rewritten: ``start`` must not be before the archive's
    ``clobberable_versions_start``.  Rows of the tail that repeat what was known go, across
    the seam too: of older versions, the newest row of the tail's keys is read, and none is
    written.  Folders of new versions take the place of old ones when the whole tail is
    written; then folders of versions that are no more go, and the notes follow, where
    ``clobberable_versions_start`` moves to ``start`` unless another is given.  Doing it again
    after a failure gives the same archive.
    """
    archive = read_archive(spark, path, fmt=fmt)
    v = archive.version
    first_open = archive.clobberable_versions_start
    if first_open is None or start < first_open:
        raise ValueError(f"versions before {first_open} are final" if first_open is not None else "all versions are final")
    if tail.columns != archive.df.columns:
        raise ValueError("the tail needs the archive's columns in the same order")
    if not tail.where((F.col(v) < F.lit(start)) | F.col(v).isNull()).isEmpty():
        raise ValueError("the tail has versions before its start")
    if not duplicate_keys(tail, [*archive.ekt, v]).isEmpty():
        raise DuplicateKeys("entity, time and version must be unique")
    tail = nan_to_null(tail, archive.values)
    old = archive.df.where(F.col(v) < F.lit(start)).join(tail.select(*archive.ekt).distinct(), archive.ekt, "left_semi")
    seam = old.groupBy(*archive.ekt).agg(F.max_by(F.struct(v, *archive.values), v).alias("__s")).select(*archive.ekt, "__s.*").select(archive.df.columns)
    rows = seam.withColumn("__seam", F.lit(True)).union(tail.withColumn("__seam", F.lit(False)))
    repeat = is_repeat(rows, archive.ekt, v, tol, archive.values)
    made = rows.withColumn("__repeat", repeat).where("NOT __seam AND NOT __repeat").drop("__seam", "__repeat")

    told = Observation("tail")
    seen = made.observe(told, F.collect_set(F.col(v).cast("string")).alias("versions"), F.max(v).alias("last"))  # a name for each version of the tail
    seen.repartition(v, *archive.keys).write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(v).save(path)
    new = set(told.get["versions"])
    at, fs = _files(spark, path)
    kind = archive.df.schema[v].dataType
    folders = {spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(f.getPath().getName().split("=", 1)[1]): f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith(f"{v}=")}
    names = spark.createDataFrame([(n,) for n in folders], "name string")
    gone = [r["name"] for r in names.where((F.col("name").cast(kind) >= F.lit(start)) & ~F.col("name").isin(list(new))).collect()]  # names of folders
    for name in gone:
        fs.delete(folders[name], True)
    ends = [e for e in (versions_end or archive.versions_end, told.get["last"]) if e is not None]
    out = archive.of(archive.df, versions_end=max(ends, default=None), clobberable_versions_start=clobberable_versions_start or start)
    _note(out, path)
    return read_archive(spark, path, fmt=fmt)


def recent_versions(archive: Archive, steps: int) -> DataFrame:
    """Rows whose version is at most ``steps`` after their time."""
    return archive.df.where(F.col(archive.version) <= shifted(F.col(archive.time), steps, archive.time_type))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which a cluster must name; a local session without it, as in tests, gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chronarch-")
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: for tables of an iteration, which then survive lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
