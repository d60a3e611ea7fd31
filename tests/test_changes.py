import os
import random

import pandas as pd
import pytest

from chronarch.archive import Archive, DuplicateKeys, Snapshot, as_archive
from chronarch.operators import changes, travel
from chronarch.operators.compaction import compactify

SNAP = "geo_value long, time_value long, value double"
ARCH = "geo_value long, time_value long, version long, value double"
EKT = ["geo_value", "time_value"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def pair(spark):
    one = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (1, 3, 3.0)], SNAP)
    two = spark.createDataFrame([(1, 2, 2.0), (1, 3, 5.0), (1, 4, 6.0)], SNAP)
    return one, two


def test_diff_of_snapshots(pair):
    assert rows(changes.diff(*pair, EKT)) == [(1, 1, None), (1, 3, 5.0), (1, 4, 6.0)]
    assert rows(changes.diff(*pair, EKT, "update")) == [(1, 3, 5.0), (1, 4, 6.0)]
    assert rows(changes.diff(None, pair[1], EKT)) == rows(pair[1])


def test_patch_gives_the_later_snapshot(pair):
    one, two = pair
    patched = changes.patch(one, changes.diff(one, two, EKT), EKT)
    assert rows(patched) == [(1, 1, None), (1, 2, 2.0), (1, 3, 5.0), (1, 4, 6.0)]
    assert rows(patched.where("value IS NOT NULL")) == rows(two)


def test_diff_refuses(pair):
    one, two = pair
    with pytest.raises(ValueError):
        changes.diff(one, two.select("time_value", "geo_value", "value"), EKT)
    with pytest.raises(ValueError):
        changes.diff(one, two, ["state"])
    with pytest.raises(ValueError):
        changes.snapshot_diff(Snapshot(one, 6), Snapshot(two, 5))
    with pytest.raises(ValueError):
        Snapshot(one.withColumnRenamed("value", "version"), 1)


def test_archive_of_snapshots(spark, pair):
    one, two = pair
    both = one.selectExpr("geo_value", "time_value", "5L AS version", "value").union(two.selectExpr("geo_value", "time_value", "6L", "value"))
    got = rows(changes.snapshots_to_archive(both, EKT))
    assert got == sorted([(1, 1, 5, 1.0), (1, 2, 5, 2.0), (1, 3, 5, 3.0), (1, 1, 6, None), (1, 3, 6, 5.0), (1, 4, 6, 6.0)], key=str)


def test_empty_snapshot_deletes_all(spark, pair):
    one = pair[0].selectExpr("geo_value", "time_value", "5L AS version", "value")
    versions = spark.createDataFrame([(5,), (6,)], "version long")
    got = rows(changes.snapshots_to_archive(one, EKT, versions=versions))
    assert [r for r in got if r[2] == 6] == [(1, 1, 6, None), (1, 2, 6, None), (1, 3, 6, None)]


def test_tolerance_compares_with_the_predecessor(spark):
    drift = spark.createDataFrame([(1, 1, v, x) for v, x in enumerate((0.0, 0.9, 1.8), 1)], ARCH)
    assert rows(compactify(drift, EKT, tol=1)) == [(1, 1, 1, 0.0)]
    jump = spark.createDataFrame([(1, 1, v, x) for v, x in enumerate((0.0, 0.9, -0.2), 1)], ARCH)
    assert rows(compactify(jump, EKT, tol=1)) == [(1, 1, 1, 0.0), (1, 1, 3, -0.2)]


def test_nulls_and_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1, 1, v, x) for v, x in enumerate((None, None, 0.0, None, inf, inf), 1)], ARCH)
    assert [r[2] for r in rows(compactify(df, EKT, tol=1))] == [1, 3, 4, 5]
    assert as_archive(spark.createDataFrame([(1, 1, 1, float("nan"))], ARCH)).df.first()["value"] is None


def test_structs_are_compared_by_field(spark):
    kind = "k long, version long, q struct<v: array<double>, m: double>"
    df = spark.createDataFrame([(1, 1, ([1.0], 1.0)), (1, 2, ([1.0], 1.4)), (1, 3, ([2.0], 1.4)), (1, 4, None)], kind)
    assert [r["version"] for r in compactify(df, ["k"], tol=0.5).orderBy("version").collect()] == [1, 3, 4]
    with pytest.raises(TypeError):
        compactify(spark.createDataFrame([(1, 1, {"a": 1})], "k long, version long, m map<string,int>"), ["k"])


def test_duplicates_are_refused(spark):
    with pytest.raises(DuplicateKeys):
        as_archive(spark.createDataFrame([(1, 1, 1, 1.0), (1, 1, 1, 2.0)], ARCH))
    with pytest.raises(ValueError):
        as_archive(spark.createDataFrame([(1, 1, 9, 1.0)], ARCH), versions_end=5, time_type="integer")
    with pytest.raises(ValueError):
        Archive(spark.createDataFrame([(1, 1, 9, 1.0)], ARCH)).where("value > 0")


def test_archives_are_filtered_by_keys_times_and_versions(spark):
    df = spark.createDataFrame([("a", 1, 1, 1.0, 2), ("b", 1, 4, 2.0, 3)], "geo_value string, time_value long, version long, value double, n long")
    a = Archive(df, time_type="integer")
    assert [r["version"] for r in a.where("geo_value = 'a'").df.collect()] == [1]
    assert [r["version"] for r in a.where("version <= 3").df.collect()] == [1]
    assert [r["version"] for r in a.where((df["geo_value"] == "b") & (df["version"] > 1)).df.collect()] == [4]
    for bad in ("value > 0", "n = 2", df["n"] > 2, "geo_value = 'a' AND coalesce(n, 0) = 2"):
        with pytest.raises(ValueError):
            a.where(bad)


def test_fold_equals_python(spark):
    rng = random.Random(3)
    now, snaps, want = {}, [], []
    for v in range(1, 15):
        old = dict(now)
        for t in rng.sample(range(8), 3):
            if rng.random() < 0.3:
                now.pop(t, None)
            else:
                now[t] = rng.choice([None, 1.0, 2.0, 3.0])
        if v == 7:
            now.clear()
        snaps += [(1, t, v, x) for t, x in now.items()]
        want += [(1, t, v, x) for t, x in now.items() if v == 1 or t not in old or old[t] != x]
        want += [(1, t, v, None) for t in old if t not in now]
    versions = spark.createDataFrame([(v,) for v in range(1, 15)], "version long")
    made = changes.snapshots_to_archive(spark.createDataFrame(snaps, ARCH), EKT, versions=versions)
    assert rows(made) == sorted(want, key=str)
    archive = Archive(made, time_type="integer")
    for v in (3, 7, 14):
        assert rows(travel.as_of(archive, v).df.where("value IS NOT NULL")) == rows(spark.createDataFrame(snaps, ARCH).where(f"version = {v} AND value IS NOT NULL").drop("version"))


def test_load_snapshots_and_map(spark):
    load = lambda v: spark.createDataFrame([(1, t, float(t)) for t in range(1, v + 1)], SNAP)
    got = changes.load_snapshots([2, 1, 2], load, EKT)
    assert sorted((r["time_value"], r["version"], r["value"]) for r in got.collect()) == [(1, 1, 1.0), (2, 2, 2.0)]

    def double(version, part):
        return part.assign(value=part["value"] * 2)

    twice = changes.map_versions(got, double, "geo_value long, time_value long, value double, version int", EKT, result="update")
    assert sorted((r["time_value"], r["value"]) for r in twice.collect()) == [(1, 2.0), (2, 4.0)]


def test_accumulator_must_return_a_pair(spark):
    df = spark.createDataFrame([(1, 1, 1, 1.0)], ARCH)
    bad = changes.map_accumulate(df, lambda acc, v, part: part, 0, ARCH, ["geo_value"], EKT)
    with pytest.raises(Exception, match="accumulator"):
        bad.collect()
    paste = lambda acc, v, part: (f"{acc} {v}", pd.DataFrame({"time_value": [1], "value": [float(len(acc))]}))
    good = changes.map_accumulate(df.union(spark.createDataFrame([(1, 1, 2, 1.0)], ARCH)), paste, "", ARCH, ["geo_value"], EKT)
    assert [r["value"] for r in good.orderBy("version").collect()] == [0.0, 2.0]


def test_fold_gives_both_from_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(g, t, v, None if v == 2 else float(t * v)) for g in (1, 2) for t in (1, 2) for v in (1, 2, 3)], ARCH)
    seen = str(tmp_path)

    def f(acc, v, rows):
        with open(f"{seen}/{rows['geo_value'].iloc[0]}-{v}", "a") as told:
            told.write("x")
        return acc + f" {v}", rows[["time_value", "value"]]

    archive, last = changes.fold_versions(df, f, "", ARCH, ["geo_value"], EKT, "string", result="update")
    want = changes.map_accumulate(df, lambda acc, v, rows: (acc, rows[["time_value", "value"]]), "", ARCH, ["geo_value"], EKT, result="update")
    assert sorted(map(str, archive.collect())) == sorted(map(str, want.collect())) and archive.columns == want.columns
    assert sorted(map(tuple, last.collect())) == [(1, " 1 2 3"), (2, " 1 2 3")]
    assert {(tmp_path / n).read_text() for n in os.listdir(tmp_path)} == {"x"} and len(os.listdir(tmp_path)) == 6
