"""Straight-line quantile regression per group.

A best line runs through two of the points.  From a line, every turn about one of the
points on it is judged by the slope of the loss; as the loss is convex and its kinks at
the line are the turns about these points, the line is best if none of them goes down.
Else the line turns about the steepest of these points to the best slope, a weighted
quantile of the slopes towards all other points.  Every turn lowers the loss and there
are only so many lines through two points, so the search ends at the optimum.

A group whose different points a task may sort is turned to its end inside that task: one
job for all such groups.  Only longer groups are turned by jobs, whose number grows with
the turns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataguild.operators.joins import same_keys
from strataguild.operators.order_stats import running
from strataguild.operators.rank_search import SHORT
from strataguild.session import marked, settle

TOLERANCE = 1e-12
# Points this close to a line, against the size of their values, are on it.
ON_LINE = 1e-9
# Weighted least-squares fits that seek the first pivot; they set the time, not the result.
START_FITS = 8


def _loss(residual: Column, tau: Column) -> Column:
    return residual * F.when(residual >= 0, tau).otherwise(tau - 1.0)


def _turn(points: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best line through each group's pivot (``hx``, ``hy``), with its loss, beside the line so far."""
    rows = same_keys(points, state, keys)
    dx = F.col("_x") - F.col("hx")
    turned = rows.where(dx != 0).select(
        *keys,
        "_x",
        "_y",
        ((F.col("_y") - F.col("hy")) / dx).alias("_s"),
        (F.col("_n") * F.abs(dx)).alias("_w"),
        (F.col("_n") * F.abs(dx) * F.when(dx > 0, F.col("tau")).otherwise(1.0 - F.col("tau"))).alias("_wt"),
    )
    placed = running(turned, keys, "_s", [("_before", "_w", "sum")], [("_goal", "_wt")], ties=["_x", "_y"])
    reached = placed.where(F.col("_before") + F.col("_w") >= F.col("_goal") * (1 - TOLERANCE))
    found = reached.groupBy(*keys).agg(F.min("_s").alias("new_slope"))
    tried = same_keys(state, found, keys).withColumn("new_intercept", F.col("hy") - F.col("new_slope") * F.col("hx"))
    r = F.col("_y") - F.col("new_intercept") - F.col("new_slope") * F.col("_x")
    cost = same_keys(points, tried, keys).groupBy(*keys).agg(F.sum(F.col("_n") * _loss(r, F.col("tau"))).alias("new_loss"))
    return same_keys(tried, cost, keys)


def _pivots(points: DataFrame, lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The point on each group's line about which a turn lowers the loss most steeply; no row for best lines."""
    rows = same_keys(points, lines, keys)
    at = F.col("intercept") + F.col("slope") * F.col("_x")
    near = F.abs(F.col("_y") - at) <= ON_LINE * F.greatest(F.abs("_y"), F.abs("intercept"), F.abs(F.col("slope") * F.col("_x")))
    rows = settle(rows.select(*keys, "_x", "_n", at.alias("_at"), near.alias("_on"), (F.col("_y") > at).alias("_above")))
    pull = F.col("_n") * F.when(F.col("_above"), F.col("tau")).otherwise(F.col("tau") - 1.0)
    off = rows.where(~F.col("_on")).groupBy(*keys).agg(F.sum(pull).alias("_s0"), F.sum(pull * F.col("_x")).alias("_s1"))
    on = rows.where("_on").groupBy(*keys, "_x").agg(F.sum("_n").alias("_n"), F.first("_at").alias("_at"))
    on = on.withColumn("_nx", F.col("_n") * F.col("_x"))
    sums = running(on, keys, "_x", [("_n0", "_n", "sum"), ("_n1", "_nx", "sum")], [("_t0", "_n"), ("_t1", "_nx")])
    both = same_keys(sums, off, keys, "left").fillna(0.0, ["_s0", "_s1"])
    c, tau = F.col("_x"), F.col("tau")
    left = c * F.col("_n0") - F.col("_n1")
    right = (F.col("_t1") - F.col("_n1") - F.col("_nx")) - c * (F.col("_t0") - F.col("_n0") - F.col("_n"))
    moment = F.col("_s1") - c * F.col("_s0")
    up = -moment + (1.0 - tau) * right + tau * left
    down = moment + tau * right + (1.0 - tau) * left
    best = both.select(*keys, F.struct(F.least(up, down).alias("_d"), c.alias("hx"), F.col("_at").alias("hy")).alias("_p"))
    found = best.groupBy(*keys).agg(F.min("_p").alias("_p")).where("_p._d < 0")
    return found.select(*keys, F.col("_p.hx").alias("hx"), F.col("_p.hy").alias("hy"))


def _start(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A point of each group near its best line, to turn about first; groups with one x are left out.

    The line is sought by a few least-squares fits that weigh a point by its loss over its squared residual.
    """
    x, y, tau = F.col("_x"), F.col("_y"), F.col("tau")
    line = points.groupBy(*keys).agg(
        F.min("_x").alias("_a"), F.max("_x").alias("_z"), F.avg("_y").alias("intercept"), F.stddev_pop("_y").alias("_sd")
    )
    line = settle(line.where("_a < _z").select(*keys, "intercept", F.lit(0.0).alias("slope"), "_sd"))
    r = y - F.col("intercept") - F.col("slope") * x
    for _ in range(START_FITS):
        small = F.greatest(F.abs(r), F.col("_sd") * 1e-3, F.lit(1e-12))
        rows = same_keys(points, line, keys).select(*keys, "_sd", x, y, (F.col("_n") * F.when(r >= 0, tau).otherwise(1.0 - tau) / small).alias("_w"))
        w = F.col("_w")
        sums = rows.groupBy(*keys).agg(
            F.first("_sd").alias("_sd"),
            *[F.sum(v).alias(f"_s{i}") for i, v in enumerate((w, w * x, w * y, w * x * x, w * x * y))],
        )
        slope = (F.col("_s0") * F.col("_s4") - F.col("_s1") * F.col("_s2")) / (F.col("_s0") * F.col("_s3") - F.col("_s1") ** 2)
        fit = sums.select(*keys, "_sd", F.coalesce(slope, F.lit(0.0)).alias("slope"), "_s0", "_s1", "_s2")
        line = settle(fit.select(*keys, ((F.col("_s2") - F.col("slope") * F.col("_s1")) / F.col("_s0")).alias("intercept"), "slope", "_sd"))
    near = F.min(F.struct(F.abs(r).alias("_r"), x.alias("hx"), y.alias("hy"))).alias("_p")
    return same_keys(points, line, keys).groupBy(*keys).agg(near).select(*keys, F.col("_p.hx").alias("hx"), F.col("_p.hy").alias("hy"))


def _turned(x, y, n, tau: float, hx: float, hy: float) -> tuple[float, float, float]:
    """Intercept, slope and loss of the best line through a pivot."""
    dx = x - hx
    other = dx != 0
    dx, w = dx[other], (n * np.abs(dx))[other]
    slopes = (y[other] - hy) / dx
    order = np.argsort(slopes, kind="stable")
    goal = (w * np.where(dx > 0, tau, 1.0 - tau)).sum()
    reached = np.cumsum(w[order]) >= goal * (1 - TOLERANCE)
    slope = slopes[order[min(int(np.argmax(reached)), len(order) - 1)]]
    intercept = hy - slope * hx
    r = y - intercept - slope * x
    return intercept, slope, (n * r * np.where(r >= 0, tau, tau - 1.0)).sum()


def _steepest(x, y, n, tau: float, intercept: float, slope: float) -> tuple[float, float] | None:
    """The point on a line about which a turn lowers the loss most steeply; none for a best line."""
    at = intercept + slope * x
    on = np.abs(y - at) <= ON_LINE * np.maximum(np.maximum(np.abs(y), abs(intercept)), np.abs(slope * x))
    if not on.any():
        return None
    pull = (n * np.where(y > at, tau, tau - 1.0))[~on]
    s0, s1 = pull.sum(), (pull * x[~on]).sum()
    c, place = np.unique(x[on], return_inverse=True)
    m = np.bincount(place, n[on])
    upto, moment = np.cumsum(m), np.cumsum(m * c)
    left = c * (upto - m) - (moment - m * c)
    right = (moment[-1] - moment) - c * (upto[-1] - upto)
    pulled = s1 - c * s0
    down = np.minimum(-pulled + (1.0 - tau) * right + tau * left, pulled + tau * right + (1.0 - tau) * left)
    best = int(np.argmin(down))
    return (c[best], intercept + slope * c[best]) if down[best] < 0 else None


def _first_pivot(x, y, n, tau: float) -> tuple[float, float]:
    """A point near the best line, sought as by ``_start``."""
    intercept, slope, sd = np.average(y), 0.0, y.std()
    for _ in range(START_FITS):
        r = y - intercept - slope * x
        w = n * np.where(r >= 0, tau, 1.0 - tau) / np.maximum(np.maximum(np.abs(r), sd * 1e-3), 1e-12)
        s0, s1, s2, s3, s4 = (v.sum() for v in (w, w * x, w * y, w * x * x, w * x * y))
        spread = s0 * s3 - s1 * s1
        slope = (s0 * s4 - s1 * s2) / spread if spread else 0.0
        intercept = (s2 - slope * s1) / s0
    r = np.abs(y - intercept - slope * x)
    near = np.lexsort((y, x, r))[0]
    return x[near], y[near]


def best_line(x, y, n, tau: float) -> tuple[float, float, float]:
    """Intercept, slope and loss of the best line through weighted points with at least two different ``x``."""
    line = _turned(x, y, n, tau, *_first_pivot(x, y, n, tau))
    while (pivot := _steepest(x, y, n, tau, *line[:2])) is not None:
        turned = _turned(x, y, n, tau, *pivot)
        if not turned[2] < line[2] - TOLERANCE * abs(line[2]):
            break
        line = turned
    return line


def _lines_of_groups(by: Sequence[str], taus: Sequence[float]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def lines(group: pd.DataFrame) -> pd.DataFrame:
        # The order of rows must not show in the last digits.
        group = group.sort_values(["_x", "_y"])
        x, y, n = (group[c].to_numpy(float) for c in ("_x", "_y", "_n"))
        many = len(np.unique(x)) > 1
        found = [(float(t), *best_line(x, y, n, float(t))) for t in taus] if many else []
        out = pd.DataFrame(found, columns=["tau", "intercept", "slope", "loss"], dtype=float)
        for c in reversed(by):
            out.insert(0, c, pd.Series([group[c].iloc[0]] * len(out), dtype=group[c].dtype))
        return out

    return lines


def _by_jobs(base: DataFrame, by: Sequence[str], taus: Sequence[float]) -> DataFrame:
    """Lines of groups of any length: every turn of all open groups is a few jobs."""
    keys = [*by, "tau"]
    points = settle(base.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus]))))
    first = _start(points, keys)
    fields = ["intercept", "slope", "loss"]
    new = [F.col(f"new_{f}").alias(f) for f in fields]
    open_ = settle(_turn(points, first, keys).select(*keys, *new))
    best = open_.limit(0)
    while not open_.isEmpty():
        turned = _turn(points, same_keys(open_, _pivots(points, open_, keys), keys), keys)
        lower = F.col("new_loss") < F.col("loss") - TOLERANCE * F.abs("loss")
        better = settle(turned.where(lower).select(*keys, *new))
        best = best.unionByName(same_keys(open_, better, keys, "left_anti"))
        open_ = better
    return best.select(*keys, *fields)


def quantile_regression(
    df: DataFrame, x: str, y: str, taus: Sequence[float], by: Sequence[str] = (), short: int = SHORT
) -> DataFrame:
    """Intercept, slope and loss of the tau-quantile line of y on x, per group and tau.

    A group needs two different x values; groups without them are left out.  Groups of more
    than ``short`` different points are turned by jobs, the others inside a task.
    """
    if not by:
        return quantile_regression(df.withColumn("_all", F.lit(1)), x, y, taus, ["_all"], short).drop("_all")
    by = list(by)
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    points = settle(
        known.groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(
            F.count(F.lit(1)).cast("double").alias("_n")
        )
    )
    long = settle(points.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > short).select(*by))
    names = ", ".join(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{names}, tau double, intercept double, slope double, loss double"
    in_task = lambda rows: rows.groupBy(*by).applyInPandas(_lines_of_groups(by, taus), schema)
    if long.isEmpty():
        return in_task(points)
    long = marked(long)
    found = _by_jobs(same_keys(points, long, by, "left_semi"), by, taus)
    return in_task(same_keys(points, long, by, "left_anti")).unionByName(found)
