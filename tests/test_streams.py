from datetime import date, timedelta

import pytest

from chronarch.archive import Archive
from chronarch.operators import sliding
from chronarch.streaming.slides import slide_stream, state_store
from chronarch.streaming.updates import compact_stream

SCHEMA = "geo_value string, time_value date, version date, x long, b boolean"
DAY = lambda k: date(2024, 1, 1) + timedelta(days=k)


def run(spark, at, lots, make, schema):
    """The stream's result after each lot of rows, and the rows of state at the end."""
    for rows in lots:
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(f"{at}/in")
        made = make(spark.readStream.schema(schema).parquet(f"{at}/in"))
        q = made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        told = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.schema(made.schema).parquet(f"{at}/out"), told[-1]


def test_stream_equals_batch_with_little_state(spark, tmp_path):
    """Two columns, revisions within three days, values deleted: the stream tells what batch does and keeps few times."""
    rows = [(g, DAY(t), DAY(t + k), None if (t + k) % 7 == 5 else 10**17 + t * k, (t + k) % 3 > 0) for g in "ab" for t in range(60) for k in (0, 1, 3)]
    lots = [[r for r in rows if lo <= (r[2] - DAY(0)).days < hi] for lo, hi in ((0, 20), (20, 40), (40, 99))]
    for f, names, align in (("sum", ["s", "t"], "right"), ("max", ["s"], "left")):
        columns = ["x", "b"][: len(names)]
        with state_store(spark):
            got, state = run(spark, f"{tmp_path}/{f}", lots, lambda u: slide_stream(u, ["geo_value"], columns, f, 4, align, lag=5, new_names=names), SCHEMA)
        a = Archive(spark.createDataFrame(rows, SCHEMA))
        want = sliding.archive_slide(a, columns, f, 4, align, form="asof", new_names=names).df
        assert got.where("late").isEmpty()
        assert got.drop("late").exceptAll(want.select(got.drop("late").columns)).isEmpty() and want.count() == got.count()
        assert state <= 2 * (5 + 4), state


def test_late_rows_are_told(spark, tmp_path):
    lots = [[("a", DAY(t), DAY(t), t, None) for t in range(10)], [("a", DAY(2), DAY(11), 5, None), ("a", DAY(9), DAY(9), 7, None), ("a", DAY(8), DAY(12), 80, None)]]
    with state_store(spark):
        got, _ = run(spark, tmp_path, lots, lambda u: slide_stream(u, ["geo_value"], ["x"], "sum", 2, lag=3, new_names=["s"]), SCHEMA)
    late = sorted((r["time_value"], r["version"], r["s"]) for r in got.where("late").collect())
    assert late == [(DAY(2), DAY(11), None), (DAY(9), DAY(9), None)]
    assert sorted((r["time_value"], r["s"]) for r in got.where(f"NOT late AND version = DATE'{DAY(12)}'").collect()) == [(DAY(8), 87), (DAY(9), 89)]
    with pytest.raises(ValueError):
        slide_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), ["geo_value"], ["x"], "sum", float("inf"))


@pytest.mark.parametrize(("kind", "values"), [("string", ["low", "high", "high", None]), ("boolean", [True, False, False, None]), ("date", [DAY(1), DAY(2), DAY(2), None])])
def test_any_type_of_value_is_kept_compact(spark, tmp_path, kind, values):
    schema = f"geo_value string, time_value date, version date, x {kind}"
    rows = [("a", DAY(1), DAY(1 + k), v) for k, v in enumerate([values[0], *values])]
    got, _ = run(spark, tmp_path, [rows[:2], rows[2:]], lambda u: compact_stream(u, ["geo_value"], "x"), schema)
    assert [(r["version"], r["x"]) for r in got.orderBy("version").collect()] == [(DAY(1), values[0]), (DAY(3), values[1]), (DAY(5), None)]
