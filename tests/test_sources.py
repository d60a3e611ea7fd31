import os
from datetime import date

from pyspark.sql import functions as F

from chronarch.sources.snapshots import load_archive, snapshot_sizes, snapshots

SCHEMA = "k string, t long, x long"
DATA = {date(2024, 1, 1): [("a", 1, 1), ("a", 2, 2)], date(2024, 1, 2): [("a", 1, 1), ("a", 2, 3)], date(2024, 1, 3): [], date(2024, 1, 5): [("a", 2, None), ("b", 1, 9)]}


def loader(at):
    def load(version):
        with open(os.path.join(at, version.isoformat()), "a") as seen:
            seen.write("x")
        return [dict(zip(("k", "t", "x"), r)) for r in DATA[version]] if version.day % 2 else DATA[version]

    return load


def test_a_range_loads_its_versions_only(spark, tmp_path):
    df = snapshots(spark, list(DATA), loader(tmp_path), SCHEMA).where(F.col("version").between(date(2024, 1, 2), date(2024, 1, 4)))
    assert df.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in df.orderBy("t").collect()] == [("a", 1, 1, date(2024, 1, 2)), ("a", 2, 3, date(2024, 1, 2))]
    assert sorted(os.listdir(tmp_path)) == ["2024-01-02", "2024-01-03"]
    late = snapshots(spark, list(DATA), loader(tmp_path), SCHEMA)
    assert late.where("version > DATE'2024-01-03' AND x = 9").count() == 1 and sorted(os.listdir(tmp_path)) == ["2024-01-02", "2024-01-03", "2024-01-05"]
    assert late.where("version = DATE'2030-01-01'").count() == 0
    assert late.where("version IN (DATE'2024-01-01', DATE'2024-01-05') OR k = 'z'").count() == 4


def test_archive_of_loaded_snapshots(spark, tmp_path):
    day = lambda k: date(2024, 1, k)
    got = sorted((r["k"], r["t"], r["version"], r["x"]) for r in load_archive(spark, list(DATA), loader(tmp_path), SCHEMA, ["k", "t"]).collect())
    assert got == [("a", 1, day(1), 1), ("a", 1, day(3), None), ("a", 2, day(1), 2), ("a", 2, day(2), 3), ("a", 2, day(3), None), ("a", 2, day(5), None), ("b", 1, day(5), 9)]
    some = load_archive(spark, list(DATA), loader(tmp_path), SCHEMA, ["k", "t"], first=day(2), last=day(3)).collect()
    assert sorted((r["k"], r["t"], r["version"], r["x"]) for r in some) == [("a", 1, day(2), 1), ("a", 1, day(3), None), ("a", 2, day(2), 3), ("a", 2, day(3), None)]
    assert sorted(map(tuple, snapshot_sizes(spark, list(DATA), loader(tmp_path), SCHEMA).collect())) == [(day(1), 2), (day(2), 2), (day(3), 0), (day(5), 2)]
