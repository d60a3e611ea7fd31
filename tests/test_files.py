import os
from datetime import date

import pytest
from pyspark.errors import PySparkException

from chronarch.archive import Archive, DuplicateKeys, as_archive
from chronarch.operators import travel
from chronarch.sources.tables import read_archive, rewrite_tail, write_archive

ARCH = "geo_value string, time_value date, version date, x long"
DAY = lambda k: date(2024, 1, k)


def rows(spark, *all_):
    return spark.createDataFrame([(g, DAY(t), DAY(v), x) for g, t, v, x in all_], ARCH)


def told(df):
    return sorted((r["geo_value"], r["time_value"].day, r["version"].day, r["x"]) for r in df.collect())


FIRST = [("a", 1, 1, 1), ("a", 1, 3, 2), ("a", 1, 5, 3), ("b", 1, 2, 7), ("b", 1, 6, 8), ("c", 2, 6, 1)]


@pytest.fixture
def stored(spark, tmp_path):
    at = f"{tmp_path}/archive"
    write_archive(as_archive(rows(spark, *FIRST), clobberable_versions_start=DAY(4), versions_end=DAY(7)), at)
    return at


def test_notes_come_back(spark, stored):
    a = read_archive(spark, stored)
    assert (a.keys, a.time_type, a.versions_end, a.clobberable_versions_start) == (("geo_value",), "day", DAY(7), DAY(4))
    assert a.df.schema.simpleString() == rows(spark).schema.simpleString()
    assert told(a.df) == FIRST
    assert told(a.final()) == [r for r in FIRST if r[2] < 4] and told(a.open()) == [r for r in FIRST if r[2] >= 4]
    assert told(read_archive(spark, stored, versions=(DAY(2), DAY(5))).df) == [r for r in FIRST if 2 <= r[2] <= 5]


def test_tail_is_rewritten_and_older_folders_stay(spark, stored):
    files = lambda: {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_ino, os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(stored) for f in fs if "version=2024-01-0" in d and d[-1] in "123"}
    before = files()
    # Repeats of what was known before the seam go, and so does a version that holds only such.
    tail = rows(spark, ("a", 1, 4, 2), ("a", 1, 6, 4), ("b", 1, 5, 7), ("d", 3, 8, None), ("a", 1, 8, 4))
    for _ in range(2):  # doing it again changes nothing
        a = rewrite_tail(spark, stored, tail, DAY(4))
        assert told(a.df) == sorted([r for r in FIRST if r[2] < 4] + [("a", 1, 6, 4), ("d", 3, 8, None)])
        assert {d for d in os.listdir(stored) if d.startswith("version=")} == {f"version=2024-01-0{k}" for k in (1, 2, 3, 6, 8)}
        assert (a.versions_end, a.clobberable_versions_start) == (DAY(8), DAY(4))
    assert before and files() == before
    assert told(rewrite_tail(spark, stored, rows(spark), DAY(6), clobberable_versions_start=DAY(9)).df) == [r for r in FIRST if r[2] < 4]
    with pytest.raises(ValueError, match="final"):
        rewrite_tail(spark, stored, rows(spark), DAY(8))


def test_tails_that_do_not_fit(spark, stored):
    for tail, start, what in ((rows(spark), DAY(3), ValueError), (rows(spark, ("a", 1, 4, 1)), DAY(5), ValueError), (rows(spark, ("a", 1, 5, 1), ("a", 1, 5, 2)), DAY(5), DuplicateKeys), (rows(spark).drop("x"), DAY(5), ValueError)):
        with pytest.raises(what):
            rewrite_tail(spark, stored, tail, start)
    write_archive(Archive(rows(spark, *FIRST)), stored + "-final")
    with pytest.raises(ValueError, match="all versions are final"):
        rewrite_tail(spark, stored + "-final", rows(spark), DAY(5))
    assert told(read_archive(spark, stored).df) == FIRST


def test_filters_of_archives(spark):
    a = Archive(rows(spark, *FIRST))
    assert told(a.where("version <= DATE'2024-01-03' AND geo_value = 'a'").df) == FIRST[:2]
    assert told(a.where("geo_value <> 'a'").df) == FIRST[3:]
    with pytest.raises(ValueError):
        a.where("x > 1")
    with pytest.raises(PySparkException, match="lower bound"):
        a.where("version >= DATE'2024-01-04'").df.collect()
    late = a.since(DAY(4))
    assert told(late.df) == [("a", 1, 4, 2), ("a", 1, 5, 3), ("b", 1, 4, 7), ("b", 1, 6, 8), ("c", 2, 6, 1)]
    for v in (4, 5, 7):
        assert sorted(map(tuple, travel.as_of(late, DAY(v)).df.collect())) == sorted(map(tuple, travel.as_of(a, DAY(v)).df.collect()))
