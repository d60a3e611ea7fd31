import random

import pytest

from chronarch.archive import Archive
from chronarch.functions.steps import slide_names, window
from chronarch.operators import sliding, travel
from chronarch.operators.compaction import compactify

ARCH = "geo_value long, time_value long, version long, value long"


def archive(spark):
    first = [(1, t, 1, 1) for t in range(1, 8)]
    return Archive(spark.createDataFrame([*first, (1, 3, 2, 8), (1, 10, 2, 5)], ARCH), time_type="integer")


@pytest.mark.parametrize("form", ["delta", "asof"])
def test_weekly_sum_by_version(spark, form):
    got = {(r["version"], r["time_value"]): r["value_7sum"] for r in sliding.archive_slide(archive(spark), "value", "sum", 7, form=form).df.collect()}
    assert got == {(1, t): None for t in range(1, 7)} | {(1, 7): 7, (2, 7): 14, (2, 10): None}


def test_forms_agree_with_a_function(spark):
    a = archive(spark)
    for align in ("right", "center", "left"):
        forms = [sliding.archive_slide(a, "value", "mean", 3, align, form=f, new_names=["x"]).df for f in ("delta", "asof")]
        forms.append(sliding.archive_slide_apply(a, "value", lambda x: sum(x) / len(x), 3, align, name="x").df)
        one, two, three = [sorted(map(tuple, f.select("time_value", "version", "x").collect()), key=str) for f in forms]
        assert one == two == three


def test_windows():
    assert (window(7).before, window(7).after) == (6, 0)
    assert (window(4, "center").before, window(4, "center").after) == (2, 1)
    assert (window(3, "left").before, window(3, "left").after) == (0, 2)
    for bad in ((0,), (1.5,), (float("inf"), "left"), (3, "up")):
        with pytest.raises(ValueError):
            window(*bad)


def test_names():
    name = lambda short, size, align, **how: slide_names(["x"], ["x", "y"], short, size, align, "day", **how)
    assert name("av", 7, "right") == ["x_7dav"]
    assert name("sum", 7, "center") == ["x_7dcsum"]
    assert name("sum", 7, "left") == ["x_7dlsum"]
    assert name("av", float("inf"), "right") == ["x_running_av"]
    assert name("av", 7, "right", prefix="a_") == ["a_x"]
    for bad in ({"prefix": "a", "new_names": ["b"]}, {"new_names": ["y"]}, {"new_names": ["a", "b"]}):
        with pytest.raises(ValueError):
            name("av", 7, "right", **bad)


def test_gaps_and_nulls_give_null(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 4, 4), (1, 5, None), (1, 6, 6)], "k long, time_value long, v long")
    got = sliding.slide(df, ["k"], ["v"], "sum", 2, time_type="integer").orderBy("time_value").collect()
    assert [r["v_2sum"] for r in got] == [None, 3, None, None, None]
    with pytest.raises(ValueError):
        sliding.slide(df, ["k"], ["v"], "mode", 2)
    with pytest.raises(ValueError):
        sliding.archive_slide(archive(spark), "value", "max", 3, form="delta")


def random_archive(spark, seed, kind="long"):
    """Gaps, revisions, deletions, times before 1970, two entities."""
    rng = random.Random(seed)
    rows = {}
    for _ in range(160):
        x = None if rng.random() < 0.15 else {"long": rng.randrange(-5, 6), "double": rng.choice([0.5, 1.5, -2.25, 4.0]), "boolean": rng.random() < 0.5}[kind]
        rows[rng.choice("ab"), rng.choice([*range(-6, 3), *range(4, 9)]), rng.randrange(12)] = x
    return Archive(spark.createDataFrame([(*k, x) for k, x in rows.items()], f"geo_value string, time_value long, version long, x {kind}"), time_type="integer")


CASES = [("long", f) for f in ("sum", "mean", "min", "max", "prod")] + [("double", f) for f in ("sum", "mean", "max")] + [("boolean", f) for f in ("all", "any", "mean", "sum")]


@pytest.mark.parametrize(("kind", "f"), CASES)
def test_archive_slide_equals_every_snapshot(spark, kind, f):
    a = random_archive(spark, f"{kind}{f}", kind)
    each = travel.as_of_each(a)
    for size, align in ((1, "right"), (4, "center"), (float("inf"), "right")) if f in ("sum", "max") else ((5, "left"),):
        want = compactify(sliding.slide(each, ["geo_value", "version"], ["x"], f, size, align, time_type="integer", new_names=["y"]).select(*a.ekt, "version", "y"), a.ekt)
        told = {tuple(r) for r in want.collect()}
        for form in ("delta", "asof") if f in ("sum", "mean") and kind != "double" else ("asof",):
            got = sliding.archive_slide(a, "x", f, size, align, form=form, new_names=["y"]).df.select(*a.ekt, "version", "y").collect()
            assert {tuple(r) for r in got} == told and len(got) == len(told), (size, align, form)


def test_rows_of_wide_and_running_slides_grow_slowly(spark):
    """Before compaction: a running slide of data revised within three steps, and a window three times as long."""
    def made(n):
        rows = spark.range(n).selectExpr("'a' AS geo_value", "id AS time_value", "explode(sequence(id, id + 3)) AS version", "id AS x")
        return Archive(rows, time_type="integer")

    running = [sliding._running_slide(made(n), ["x"], "sum", ["y"]).count() for n in (100, 400)]
    assert running[1] <= 4.2 * running[0] and running[1] <= 5 * 4 * 400
    wide = [sliding._block_slide(made(300), ["x"], "max", window(size), ["y"]).count() for size in (10, 30, 90)]
    assert wide[2] <= 3.3 * wide[1] <= 3.3 * 3.3 * wide[0] and wide[2] <= 4 * 90 * 300


def test_names_follow_each_columns_type(spark):
    df = spark.createDataFrame([("a", 1, 1, True), ("a", 2, 3, False)], "geo_value string, time_value long, x long, b boolean")
    made = sliding.slide(df, ["geo_value"], ["x", "b"], "mean", 2, time_type="integer")
    assert made.columns[4:] == ["x_2av", "b_2prop"]
    assert sliding.slide(df, ["geo_value"], ["x", "b"], "sum", 2, "left", time_type="integer", prefix="{f}_of_", suffix="_{n}{align}").columns[4:] == ["sum_of_x_2l", "count_of_b_2l"]
    with pytest.raises(ValueError, match="know"):
        sliding.slide(df, ["geo_value"], ["x"], "sum", 2, time_type="integer", suffix="{window}")
