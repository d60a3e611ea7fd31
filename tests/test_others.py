import numpy as np
import pandas as pd
import pytest

from chronarch.archive import Archive
from chronarch.operators import grouping, joining, nowcast, shaping, travel
from chronarch.sources.tables import read_archive, write_archive

ARCH = "geo_value long, time_value long, version long, var1 long, var2 long"


def toy(spark):
    rows = [(1, 1, 6, 1, 11), (1, 1, 7, 1, 11), (2, 1, 6, 101, 111), (2, 2, 7, None, 112)]
    return Archive(spark.createDataFrame(rows, ARCH), time_type="integer")


def test_change_keys(spark):
    for column in ("var1", "var2"):
        got = sorted(map(tuple, travel.change_keys(toy(spark), [column]).collect()))
        assert got == [(1, 1, 6), (2, 1, 6), (2, 2, 7)]


def test_merge_needs_other_columns(spark):
    with pytest.raises(ValueError):
        travel.merge_locf(toy(spark), toy(spark))


def test_groups_without_rows_stay(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 1.0), (1, "b", 1.0)], "g long, a string, b double")
    domain = spark.createDataFrame([(1, x) for x in "abcde"], "g long, a string")
    got = grouping.group_nest(df, ["g", "a"], domain)
    assert {r["a"]: len(r["data"]) for r in got.collect()} == {"a": 2, "b": 1, "c": 0, "d": 0, "e": 0}


def test_group_modify(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4), (3, 5)], "g long, v long")
    got = grouping.group_modify(df, ["g"], lambda rows, key: pd.DataFrame({"s": [rows["v"].sum()]}), "s long")
    assert sorted(map(tuple, got.collect())) == [(1, 6), (2, 4), (3, 5)]
    with pytest.raises(ValueError):
        grouping.group_modify(df, ["g"], lambda rows, key: rows, "g long")


def test_mutate_new_and_union(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    with pytest.raises(ValueError):
        shaping.mutate_new(df, a=df.b)
    assert shaping.union_fill(df, df.drop("b")).where("b IS NULL").count() == 1


def test_null_safe_joins(spark):
    x = spark.createDataFrame([(1, None), (2, 1)], "a long, b long")
    assert joining.anti_join(x, x.limit(1), ["a", "b"]).collect()[0]["a"] == 2
    y = spark.createDataFrame([(2, None)], "a long, b long")
    assert {r["a"]: r["b"] for r in joining.update_join(x, y, ["a"]).collect()} == {1: None, 2: None}


def test_median_line():
    x = np.arange(20.0)
    y = 3 + 2 * x
    y[5] += 100
    a, b = nowcast.median_line(x, y)
    assert abs(a - 3) < 1e-6 and abs(b - 2) < 1e-6
    assert nowcast.median_line(np.ones(3), np.array([1.0, 5.0, 2.0])) == (2.0, 0.0)
    rng = np.random.default_rng(1)
    for n in (2, 3, 4, 9, 20):
        for _ in range(20):
            x, y = rng.integers(0, 6, n).astype(float), rng.integers(-9, 9, n).astype(float)
            lines = [((y[j] - y[i]) / (x[j] - x[i]), i) for i in range(n) for j in range(n) if x[i] != x[j]] + [(0.0, i) for i in range(n)]
            best = min(np.sum(np.abs(y - y[i] - s * (x - x[i]))) for s, i in lines)
            a, b = nowcast.median_line(x, y)
            assert np.sum(np.abs(y - a - b * x)) <= best + 1e-6


def test_constant_features_leave_the_mean(spark):
    df = spark.createDataFrame([("a", 1.0, float(k)) for k in range(4)] + [("b", float(k), 2.0 * k) for k in range(4)], "g string, x double, y double")
    got = {r["g"]: (r["slope"], r["intercept"]) for r in nowcast.ols_by(df, ["g"], "y", "x", 2).collect()}
    assert got["a"] == (None, 1.5) and abs(got["b"][0] - 2) < 1e-9 and abs(got["b"][1]) < 1e-9


def test_groups_of_a_slide_are_all_keys(spark):
    from chronarch.operators import sliding

    a = toy(spark)
    with pytest.raises(ValueError):
        sliding.archive_slide(a, a.values[0], "sum", 2, groups=[])


def test_streams_of_long_numbers_file_by_file(spark, tmp_path):
    from chronarch.streaming.updates import compact_stream

    big = 2**60
    kind = "geo_value string, time_value long, version long, value long"
    for k, rows in enumerate([[("a", 1, 1, big)], [("a", 1, 2, big + 1)], [("a", 1, 3, big + 1), ("a", 2, 3, None)], [("a", 1, 2, 5)]]):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    made = compact_stream(stream, ["geo_value"], "value")
    made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(made.schema).parquet(f"{tmp_path}/out").collect() if r["value"] is not None)
    assert got == [("a", 1, 1, big, False), ("a", 1, 2, 5, True), ("a", 1, 2, big + 1, False)]


def test_archives_in_files(spark, tmp_path):
    a = toy(spark)
    write_archive(a, str(tmp_path / "x"))
    back = read_archive(spark, str(tmp_path / "x"), versions=(7, 9), time_type="integer")
    assert sorted(r["geo_value"] for r in back.df.collect()) == [1, 2]
    assert "PartitionFilters: [isnotnull(version" in back.df._jdf.queryExecution().toString()


def test_library_does_not_need_the_corpus_operators():
    import os
    import re

    top = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "chronarch")
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) != "llm":
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name)) as f:
                    assert not re.search(r"chronarch\.llm|import llm", f.read()), name
