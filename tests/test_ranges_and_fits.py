import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronarch.operators import joining, nowcast, shaping


def plan_rows(df, operator):
    """Output rows of the plan's nodes of a kind, after the query ran."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        metric = node.metrics().get("numOutputRows")
        if operator in node.nodeName() and metric.isDefined():
            out.append(metric.get().value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return out


@pytest.mark.parametrize("kind", ["long", "double", "date"])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_interval_joins_equal_all_pairs(spark, kind, by):
    rng = random.Random(f"{kind}{by}")

    def value(x):
        return date(1970, 1, 1) + timedelta(days=x) if kind == "date" else x / 7 if kind == "double" else x

    def rows(n):
        out = []
        for _ in range(n):
            a = rng.randrange(-300, 300)
            b = a + rng.choice([0, 0, 1, 5, 40, 500, -3])
            out.append((rng.choice("pq"), *[None if rng.random() < 0.05 else value(x) for x in (a, b)]))
        return out

    x, y = rows(120), rows(100)
    got = joining.interval_join(spark.createDataFrame(x, f"k string, a {kind}, b {kind}"), spark.createDataFrame([(*r, i) for i, r in enumerate(y)], f"k string, c {kind}, d {kind}, i long"), by, "a", "b", "c", "d")
    key = lambda r: tuple((v is not None, v) for v in r)
    want = [(*p, *q[1:], i) for p in x for i, q in enumerate(y) if None not in (*p, *q) and p[1] <= p[2] and p[1] >= q[1] and p[2] <= q[2] and (not by or p[0] == q[0])]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and want


def test_interval_join_compares_few_rows(spark):
    """Short intervals among many long ones: what meets in bins stays near the number of pairs."""
    x = spark.range(4000).selectExpr("id * 10 AS a", "id * 10 + 3 AS b")
    y = spark.range(4000).selectExpr("id * 10 - 1 AS c", "id * 10 + CASE WHEN id % 500 = 0 THEN 4000 ELSE 5 END AS d", "id")
    pairs = joining.interval_join(x, y, [], "a", "b", "c", "d")
    assert pairs.count() > 4000
    assert max(plan_rows(pairs, "Generate")) <= 3 * 4000


def test_nest_join_between(spark):
    x = spark.createDataFrame([("p", 1, 3), ("p", 1, 3), ("p", 9, 8), ("q", None, 3), ("q", 0, 100), ("r", 1, 2)], "k string, lo long, hi long")
    y = spark.createDataFrame([("p", 1, "b"), ("p", 3, "a"), ("p", 4, "c"), ("q", 50, "d"), ("q", None, "e")], "k string, v long, w string")
    got = [(r["k"], r["lo"], [(z["w"], z["v"]) for z in r["all"]]) for r in joining.nest_join_between(x, y, ["k"], "lo", "hi", "v", "all", ["w"]).collect()]
    assert sorted(got, key=str) == sorted([("p", 1, [("a", 3), ("b", 1)]), ("p", 1, [("a", 3), ("b", 1)]), ("p", 9, []), ("q", None, []), ("q", 0, [("d", 50)]), ("r", 1, [])], key=str)
    assert joining.nest_join_between(x, y.limit(0), [], "lo", "hi", "v", "all", ["w"]).where("size(all) = 0").count() == 6


def test_least_squares_leaves_out_what_depends(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(6):
        a, b = rng.normal(size=40), rng.normal(size=40) * 100
        rows += [(g, float(p), float(q), float(2 * p - 1), 3.0, float(1 + 2 * p - 0.5 * q + rng.normal())) for p, q in zip(a, b)]
    rows += [(0, None, 1.0, 1.0, 3.0, 1.0), (0, float("nan"), 1.0, 1.0, 3.0, 1.0)] + [(7, float(k), 1.0 * k * k, 2.0, 3.0, 1.0) for k in range(5)] + [(8, float(k), 2.0 * k, 2.0, 3.0, 4.0) for k in range(12)]
    df = spark.createDataFrame(rows, "g long, a double, b double, a2 double, one double, y double")
    fits = {r["g"]: r for r in nowcast.ols_many(df, ["g"], "y", ["a", "one", "b", "a2"]).collect()}
    for g in range(6):
        own = np.array([r[1:] for r in rows if r[0] == g and None not in r and r[1] == r[1]])
        x = np.column_stack([np.ones(len(own)), own[:, 0], own[:, 1]])
        want, rest, *_ = np.linalg.lstsq(x, own[:, 4], rcond=None)
        r = fits[g]
        assert np.allclose([r["intercept"], r["a"], r["b"]], want) and r["one"] is None and r["a2"] is None and r["n"] == 40
        assert np.isclose(r["r2"], 1 - rest[0] / np.sum((own[:, 4] - own[:, 4].mean()) ** 2))
    assert all(fits[7][c] is None for c in ("intercept", "a", "b", "r2")) and fits[7]["n"] == 5
    assert fits[8]["intercept"] == 4 and fits[8]["a"] == 0 and fits[8]["b"] is None and fits[8]["r2"] is None
    assert nowcast.ols_many(df, [], "y", ["a", "b"]).count() == 1 and nowcast.ols_many(df.limit(0), ["g"], "y", ["a"]).count() == 0


def test_first_ids(spark):
    nan = float("nan")
    rows = [(5, nan, [1, None], ("x", None)), (3, nan, [1, None], ("x", None)), (4, None, [1], None), (9, None, [1], None), (1, 0.0, [], ("x", 1)), (2, -0.0, [], ("x", 1)), (7, 1.0, None, ("x", None))]
    df = spark.createDataFrame(rows, "id long, d double, l array<int>, s struct<a: string, b: int>")
    want = {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 7: 7, 9: 4}
    for digest in (shaping._digest, lambda columns: F.lit(0)):  # all digests clash
        assert {r["id"]: r["first_id"] for r in shaping.first_ids(df, "id", digest=digest).collect()} == want
    assert {r["id"]: r["f"] for r in shaping.first_ids(df, "id", ["s"], "f").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 3, 7: 3, 9: 4}
    assert shaping.any_duplicates(df, "id") and not shaping.any_duplicates(df.where("id IN (1, 3, 4)"), "id")
    with pytest.raises(TypeError):
        shaping.first_ids(df.withColumn("m", F.array(F.create_map(F.lit("a"), F.lit(1)))), "id")


def test_median_lines_of_whole_groups(spark):
    """By rounds of Spark's sums, the same as by one task for each group; groups of ties, constants and few rows."""
    rng = np.random.default_rng(8)
    rows = [(f"g{g}", float(x), float(y)) for g in range(5) for x, y in zip(rng.integers(0, 30, 61).astype(float), rng.standard_t(2, 61) * 10 ** (g - 2))]
    rows += [("flat", 2.0, float(y)) for y in range(9)] + [("few", 1.0, 2.0), ("few", 2.0, 3.0)] + [("line", float(x), 5e6 - 3.0 * x) for x in range(8)]
    df = spark.createDataFrame([(*r, None) for r in rows], "g string, a double, y double, never double").repartition(3)
    got = [{(r["g"], r["feature"]): (r["n"], r["score"]) for r in nowcast.score_features(df, ["a", "never"], "y", ["g"], most=most).collect()} for most in (10**6, 0)]
    assert got[0].keys() == got[1].keys() == {(g, "a") for g in ("g0", "g1", "g2", "g3", "g4", "flat", "few", "line")}
    for k, (n, score) in got[0].items():
        assert got[1][k][0] == n and (score is None) == (got[1][k][1] is None)
        assert score is None or np.isclose(score, got[1][k][1], rtol=1e-9, atol=1e-6)
