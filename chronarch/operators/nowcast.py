"""Features for nowcasting: what is known of the latest times, and the same cells in the past.

A feature sums cells (horizon, lag): the value ``horizon`` steps from the time in
question as it was known ``lag`` steps after that time.  The cells available at
test time are the feature's template; training rows take the same cells, so a
model sees in training only what it will see when used.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronarch.archive import Archive
from chronarch.functions.steps import shifted, step, window
from chronarch.operators.shaping import complete, top_with_ties
from chronarch.operators.travel import as_of, change_keys, corresponding_versions, lookup
from chronarch.sources.tables import cut

SPEC = "predictor string, offset int, window_size int, align string, horizon int, before int, after int, feature string"


def feature_specs(spark: SparkSession, predictors: list[str], offsets: list[int], sizes: list[int], align: str = "right") -> DataFrame:
    """A row for each predictor, offset and window, with the window's reach and the feature's name."""
    rows = []
    for p in predictors:
        for o in offsets:
            for n in sizes:
                w = window(n, align)
                rows.append((p, o, n, align, o, w.before, w.after, f"{p}_{'m' if o < 0 else 'p'}{abs(o)}_w{n}"))
    return spark.createDataFrame(rows, SPEC)


def templates(archive: Archive, specs: DataFrame, test_time, as_of_version) -> DataFrame:
    """(entity, predictor, feature, template): for each entity the cells (horizon, lag) of each feature that are known.

    A cell's lag is that of the newest change known at ``as_of_version``, told from
    ``test_time``.  Cells never reported are left out.
    """
    out = []
    for p in [r[0] for r in specs.select("predictor").distinct().orderBy("predictor").collect()]:  # specifications only
        newest = change_keys(archive, [p]).where(F.col(archive.version) <= F.lit(as_of_version)).groupBy(*archive.ekt).agg(F.max(archive.version).alias("__v"))
        base = step(F.lit(test_time), archive.time_type)
        cells = newest.select(*archive.keys, (step(F.col(archive.time), archive.time_type) - base).cast("int").alias("horizon"), (step(F.col("__v"), archive.time_type) - base).cast("int").alias("lag"))
        own = specs.where(F.col("predictor") == p).select("predictor", "feature", (F.col("horizon") - F.col("before")).alias("__low"), (F.col("horizon") + F.col("after")).alias("__high"))
        spread = own.select("predictor", "feature", F.explode(F.sequence("__low", "__high")).alias("horizon"))
        out.append(cells.join(spread, "horizon").groupBy(*archive.keys, "predictor", "feature").agg(F.array_sort(F.collect_list(F.struct("horizon", "lag"))).alias("template")))
    made = out[0]
    for more in out[1:]:
        made = made.union(more)
    return made


def tasks(found: DataFrame, keys: list[str]) -> DataFrame:
    """(predictor, feature, template, entities): entities with the same template share a model."""
    return found.groupBy("predictor", "feature", "template").agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("entities"))


def template_features(archive: Archive, rows: DataFrame, found: DataFrame, tolerance: int | None = None, predictors: list[str] | None = None) -> DataFrame:
    """(entity, time, feature, value): for each row (entity, time) its entity's features; null if a cell is missing.

    All cells of a predictor are looked up in one as-of join.  ``predictors`` names those of the
    templates; without it, the templates are worked out once to learn the names.
    """
    cells = found.select(*archive.keys, "predictor", "feature", F.size("template").alias("__n"), F.explode("template").alias("__cell"))
    wanted = rows.select(*archive.ekt).distinct().join(cells, list(archive.keys))
    out = []
    predictors = predictors or [r[0] for r in found.select("predictor").distinct().orderBy("predictor").collect()]  # names only
    for p in predictors:
        t = F.col(archive.time)
        own = lookup(archive, wanted.where(F.col("predictor") == p), p, shifted(t, F.col("__cell.horizon"), archive.time_type), shifted(t, F.col("__cell.lag"), archive.time_type), "__x", tolerance)
        out.append(own.groupBy(*archive.ekt, "feature").agg(F.when(F.count("__x") == F.max("__n"), F.sum("__x")).alias("value")))
    made = out[0]
    for more in out[1:]:
        made = made.union(more)
    return made


def training_table(archive: Archive, targets: DataFrame, features: DataFrame, names: list[str], target_features: list[str]) -> DataFrame:
    """``targets`` (entity, time, ...) with a column for each feature; rows need one of ``target_features``."""
    wide = features.groupBy(*archive.ekt).pivot("feature", names).agg(F.first("value"))
    return targets.join(wide, archive.ekt).where(F.coalesce(*target_features).isNotNull())


def testing_table(archive: Archive, entities: DataFrame, found: DataFrame, names: list[str], test_time, predictors: list[str] | None = None) -> DataFrame:
    """A row for each of ``entities`` at the test time, with a column for each feature and an intercept of 1.

    A cell counts only if it has the very version that its template names; a feature
    that lacks one is null.
    """
    rows = entities.select(*archive.keys).distinct().withColumn(archive.time, F.lit(test_time))
    features = template_features(archive, rows, found, 0, predictors)
    wide = features.groupBy(*archive.ekt).pivot("feature", names).agg(F.first("value"))
    return rows.join(wide, archive.ekt, "left").withColumn("intercept", F.lit(1.0))


def contributing_values(archive: Archive, predictor: str, feature_time, before: int, after: int, as_of_version) -> DataFrame:
    """(entity, tv): for every entity of the snapshot, the times about ``feature_time`` with a value and the versions of their last change; an empty list without any."""
    known = as_of(archive, as_of_version).df
    t = step(F.col(archive.time), archive.time_type)
    base = step(F.lit(feature_time), archive.time_type)
    near = known.where(t.between(base - before, base + after) & F.col(predictor).isNotNull()).select(*archive.ekt)
    near = corresponding_versions(near, change_keys(archive, [predictor]), archive, as_of_version)
    nested = near.groupBy(*archive.keys).agg(F.array_sort(F.collect_list(F.struct(F.col(archive.time), "key_version"))).alias("tv"))
    domain = known.select(*archive.keys).distinct()
    return complete(nested, domain, {}).withColumn("tv", F.coalesce("tv", F.array()))


def ols_by(df: DataFrame, by: list[str], y: str, x: str, least: int = 10) -> DataFrame:
    """(by, n, slope, intercept) of the line of y on x, null with fewer than ``least`` rows.

    A constant x says no more than the intercept: its slope is null, the intercept the mean of y.
    """
    constant = F.regr_sxx(y, x) == 0
    mean = F.avg(F.when(F.col(x).isNotNull(), F.col(y)))
    fit = df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.when(~constant, F.regr_slope(y, x)).alias("__s"), F.when(constant, mean).otherwise(F.regr_intercept(y, x)).alias("__i"))
    return fit.select(*by, "n", F.when(F.col("n") >= least, F.col("__s")).alias("slope"), F.when(F.col("n") >= least, F.col("__i")).alias("intercept"))


#: A regressor of which less than this part of its sum of squares is left beside those before it is a combination of them.
DEPENDENT = 1e-9


def least_squares(gram: np.ndarray, size: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, sums of squared residuals) of many fits at once, each with an intercept first.

    ``gram`` has the centred sums of products of regressors and, last, of the target (fits, k + 1, k + 1).
    Regressors are swept in turn; one that depends on those before it is left out, its coefficient NaN.
    """
    a, k = gram.copy(), gram.shape[1] - 1
    whole = np.einsum("fii->fi", gram)[:, :k].copy()
    used = np.zeros((len(a), k), bool)
    for j in range(k):
        pivot = a[:, j, j].copy()
        some = used[:, j] = (pivot > DEPENDENT * whole[:, j]) & (whole[:, j] > 0)
        row = a[:, j, :].copy()
        factor = np.where(some[:, None], a[:, :, j] / np.where(some, pivot, 1)[:, None], 0)
        a -= factor[:, :, None] * row[:, None, :] * some[:, None, None]
        a[:, :, j] = np.where(some[:, None], -factor, a[:, :, j])
        a[:, j, :] = np.where(some[:, None], row / np.where(some, pivot, 1)[:, None], a[:, j, :])
        a[:, j, j] = np.where(some, 1 / np.where(some, pivot, 1), a[:, j, j])
    slopes = np.where(used, a[:, :k, k], np.nan)
    intercept = mean[:, k] - np.nansum(slopes * mean[:, :k], 1)
    return np.concatenate([intercept[:, None], slopes], 1), np.maximum(a[:, k, k], 0)


def ols_many(df: DataFrame, by: list[str], y: str, xs: list[str], least: int = 10) -> DataFrame:
    """(by, n, intercept, one column for each regressor, r2) of the least squares of y on all of ``xs``; ``by`` may be empty.

    Rows with a null or NaN in any of them are left out.  Spark sums up products of each pair, in one
    shuffle, so a group of any size is a few numbers; those are solved in batches of groups.
    A constant regressor, or one that depends on those before it, is null and plays no part.
    With fewer than ``least`` rows all is null; r2 is null for a constant y.
    """
    names = [*xs, y]
    whole = df.select(*by, *[F.col(c).cast("double").alias(f"__v{k}") for k, c in enumerate(names)])
    whole = whole.where(F.lit(True) if not names else reduce(lambda p, q: p & q, [F.col(f"__v{k}").isNotNull() & ~F.isnan(f"__v{k}") for k in range(len(names))]))
    m = len(names)
    pairs = [(i, j) for i in range(m) for j in range(i + 1)]
    sums = whole.groupBy(*by).agg(F.count("*").alias("__n"), F.array(*[F.avg(f"__v{k}") for k in range(m)]).alias("__mean"), F.array(*[F.covar_pop(f"__v{i}", f"__v{j}") for i, j in pairs]).alias("__cov"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch["__n"].to_numpy()
            mean = np.array(batch["__mean"].to_pylist(), float).reshape(len(n), m)
            cov = np.array([[np.nan if c is None else c for c in r] for r in batch["__cov"].to_pylist()], float).reshape(len(n), len(pairs))
            gram = np.zeros((len(n), m, m))
            for k, (i, j) in enumerate(pairs):
                gram[:, i, j] = gram[:, j, i] = cov[:, k] * n
            fit, rest = least_squares(gram, n, mean)
            fit[n < least] = np.nan
            total = gram[:, m - 1, m - 1]
            r2 = np.where((n >= least) & (total > 0), 1 - rest / np.where(total > 0, total, 1), np.nan)
            out = {c: batch[c] for c in by} | {"__n": batch["__n"]}
            out |= {f"__c{k}": pa.array(fit[:, k], pa.float64(), mask=np.isnan(fit[:, k])) for k in range(m)}
            yield pa.RecordBatch.from_pydict(out | {"__r2": pa.array(r2, pa.float64(), mask=np.isnan(r2))})

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    fits = sums.mapInArrow(solve, f"{kinds}__n long, " + ", ".join(f"__c{k} double" for k in range(m)) + ", __r2 double")
    return fits.select(*by, F.col("__n").alias("n"), F.col("__c0").alias("intercept"), *[F.col(f"__c{k + 1}").alias(x) for k, x in enumerate(xs)], F.col("__r2").alias("r2"))


def median_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of least absolute deviations; a constant x gives the median.

    For each slope the median is the best intercept, and what is left is convex in
    the slope.  A best line goes through two of the points, so its slope lies between
    the least and the greatest slope of neighbours in x.
    """
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    begin = np.flatnonzero(np.r_[True, np.diff(x) > 0])
    if len(begin) < 2:
        return float(np.median(y)), 0.0
    low, high, at = y[begin], y[np.r_[begin[1:], len(y)] - 1], x[begin]
    a, b = np.min((low[1:] - high[:-1]) / np.diff(at)), np.max((high[1:] - low[:-1]) / np.diff(at))

    def left(slope: float) -> float:
        rest = y - slope * x
        return float(np.sum(np.abs(rest - np.median(rest))))

    golden = (np.sqrt(5) - 1) / 2
    c, d = b - golden * (b - a), a + golden * (b - a)
    at_c, at_d = left(c), left(d)
    while b - a > 1e-13 * max(1.0, abs(a), abs(b)) and c < d:
        if at_c <= at_d:
            b, d, at_d = d, c, at_c
            at_c = left(c := b - golden * (b - a))
        else:
            a, c, at_c = c, d, at_d
            at_d = left(d := a + golden * (b - a))
    slope = (a + b) / 2
    return float(np.median(y - slope * x)), float(slope)


#: Slopes tried in a round, rounds at most, and the part of a slope that is left open.
SLOPES, ROUNDS, OPEN = 40, 30, 1e-12


def median_lines(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, slope, intercept, score) of the lines of least absolute deviations of y on x, and what they leave on average.

    What is left is convex in the slope, with the median of the rest as the intercept.  Each round
    works out ``SLOPES`` slopes of every group between two bounds, medians first, then
    sums, and takes those next to the best as bounds; where the best is a bound, it goes
    further out.  Rows stay where they are and only sums are shuffled, so a group may be of any
    size.  Medians are exact for groups of up to 10,000 rows; beyond, their ranks are off by one in
    20,000 at most, and what is left by far less.
    """
    rows = cut(rows.select(*by, "x", "y"))
    start = rows.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.regr_slope("y", "x"), F.lit(0.0)).alias("__s"), F.stddev_pop("x").alias("__dx"), F.stddev_pop("y").alias("__dy"))
    wide = F.when(F.col("__dx") > 0, F.col("__dy") / F.col("__dx") + 1e-12 * (1 + F.abs("__s"))).otherwise(0.0)
    state = start.select(*by, "n", wide.alias("__scale"), (F.col("__s") - wide).alias("__a"), (F.col("__s") + wide).alias("__b"), *[F.lit(None).cast("double").alias(c) for c in ("slope", "intercept", "__left")])
    slope = lambda k: F.col("__a") + (F.col("__b") - F.col("__a")) * (k / (SLOPES - 1))
    for _ in range(ROUNDS):
        state = cut(state)
        open_ = state.where("__b > __a OR __left IS NULL")
        if open_.isEmpty():
            break
        known = rows.join(open_.select(*by, "__a", "__b"), by)
        middle = known.groupBy(*by).agg(F.array(*[F.percentile_approx(F.col("y") - slope(k) * F.col("x"), 0.5, 10000) for k in range(SLOPES)]).alias("__m"))
        middle = cut(open_.join(middle, by))
        left = rows.join(middle.select(*by, "__a", "__b", "__m"), by).groupBy(*by).agg(F.array(*[F.sum(F.abs(F.col("y") - slope(k) * F.col("x") - F.col("__m")[k])) for k in range(SLOPES)]).alias("__f"))
        told = middle.join(left, by).withColumn("__k", F.array_position("__f", F.array_min("__f")).cast("int") - 1)
        at = lambda k: F.col("__a") + (F.col("__b") - F.col("__a")) * k / (SLOPES - 1)
        k, width = F.col("__k"), F.col("__b") - F.col("__a")
        better = F.col("__left").isNull() | (F.array_min("__f") < F.col("__left"))
        low = F.when(k == 0, F.col("__a") - 8 * width).otherwise(at(k - 1))
        high = F.when(k == SLOPES - 1, F.col("__b") + 8 * width).otherwise(at(k + 1))
        done = (high - low) <= OPEN * F.greatest("__scale", F.abs(low), F.abs(high))
        moved = told.select(
            *by, "n", "__scale", F.when(width == 0, F.col("__a")).otherwise(low).alias("__a"), F.when(width == 0, F.col("__a")).when(done, low).otherwise(high).alias("__b"),
            F.when(better, at(k)).otherwise(F.col("slope")).alias("slope"), F.when(better, F.col("__m")[k]).otherwise(F.col("intercept")).alias("intercept"), F.least("__left", F.array_min("__f")).alias("__left"),
        )
        state = moved.union(state.where("NOT (__b > __a OR __left IS NULL)").select(moved.columns))
    return state.select(*by, "n", "slope", "intercept", (F.col("__left") / F.col("n")).alias("score"))


def score_features(df: DataFrame, features: list[str], target: str, by: list[str] | None = None, ratio: int = 2, least: int = 15, time: str | None = None, reference=None, nearest: int | None = None, most: int = 100_000) -> DataFrame:
    """(by, feature, n, score): mean absolute residual of the median line of target on each feature; null with fewer than min(2 * ratio, least) rows.

    With ``nearest``, only so many rows of times nearest to ``reference`` count, and
    those that tie with the last of them: Spark picks them, so a fit has few rows.
    Groups of up to ``most`` rows are fitted in one task each, larger ones by ``median_lines``.
    """
    by = by or []
    long = df.unpivot([*by, *([time] if time else []), target], features, "feature", "x").where(F.col("x").isNotNull() & F.col(target).isNotNull())
    if nearest is not None:
        long = top_with_ties(long, [*by, "feature"], F.abs(F.datediff(F.col(time), F.lit(reference))), nearest)
    long = long.select(*by, "feature", F.col("x").cast("double").alias("x"), F.col(target).cast("double").alias("y"))
    enough = min(2 * ratio, least)
    kinds = {x.name: x.dataType.simpleString() for x in df.schema.fields}

    def score(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
        told = None
        if len(x) >= enough:
            a, b = median_line(x, y)
            told = float(np.mean(np.abs(y - a - b * x)))
        return pd.DataFrame([(*key, len(x), told)], columns=[*by, "feature", "n", "score"])

    in_tasks = lambda rows: rows.groupBy(*by, "feature").applyInPandas(score, "".join(f"`{c}` {kinds[c]}, " for c in by) + "feature string, n long, score double")
    if nearest is not None:  # few rows by the ranking, but for ties
        return in_tasks(long)
    long = cut(long)
    large = long.groupBy(*by, "feature").agg(F.count("*").alias("n")).where(F.col("n") > most).select(*by, "feature")
    large = cut(large)
    if large.isEmpty():
        return in_tasks(long)
    lines = median_lines(long.join(large, [*by, "feature"], "left_semi"), [*by, "feature"])
    whole = lines.select(*by, "feature", "n", F.when(F.col("n") >= enough, F.col("score")).alias("score"))
    return whole.union(in_tasks(long.join(large, [*by, "feature"], "left_anti")))


def mean_scaled(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """``df`` with a column over its group's mean."""
    mean = df.groupBy(*by).agg(F.avg(column).alias("__m"))
    return df.join(mean, by).withColumn(name, F.col(column) / F.col("__m")).drop("__m")
