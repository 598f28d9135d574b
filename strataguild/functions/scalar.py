"""Row-level expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc(col: Column) -> Column:
    """Round towards zero."""
    return F.signum(col) * F.floor(F.abs(col))


def positive_ln(col: Column) -> Column:
    """Natural log; zero, negative and null inputs give null."""
    return F.when(col > 0, F.ln(col))


def percent_change(col: Column, base: Column) -> Column:
    return (col - base) / base * 100.0


def parse_number(col: Column) -> Column:
    """First number inside a text, such as ``110`` in ``110 cm``; commas between digits group thousands."""
    found = F.regexp_extract(col, r"(-?(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+))", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def _any_null(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, [c.isNull() for c in cols])


def row_max(cols: Sequence[Column], skip_null: bool = False) -> Column:
    best = F.greatest(*cols) if len(cols) > 1 else cols[0]
    return best if skip_null else F.when(~_any_null(cols), best)


def row_min(cols: Sequence[Column], skip_null: bool = False) -> Column:
    best = F.least(*cols) if len(cols) > 1 else cols[0]
    return best if skip_null else F.when(~_any_null(cols), best)


def row_sum(cols: Sequence[Column], skip_null: bool = False) -> Column:
    if skip_null:
        cols = [F.coalesce(c, F.lit(0)) for c in cols]
    return reduce(add, cols)


def row_arg_max(cols: Sequence[Column], labels: Sequence[str]) -> Column:
    """Label of the largest value in the row, the first one on ties."""
    top = row_max(cols)
    picks = [F.when(c == top, F.lit(label)) for c, label in zip(cols, labels)]
    return F.coalesce(*picks)


def recode(col: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values; everything else passes through."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col), col)


def first_true(cases: Sequence[tuple[Column, object]]) -> Column:
    """Value of the first condition that holds, else null."""
    (cond, value), *rest = cases
    out = F.when(cond, F.lit(value))
    for cond, value in rest:
        out = out.when(cond, F.lit(value))
    return out


def override(new: Column, old: Column, sentinel: str | None = None) -> Column:
    """New value where there is one (and it is not the sentinel), else the old one."""
    return F.coalesce(F.nullif(new, F.lit(sentinel)) if sentinel is not None else new, old)


def interval_label(
    col: Column,
    bounds: Sequence[tuple[str, float, float]],
    closed: str = "right",
) -> Column:
    """Name of the interval (label, low, high) that holds the value, else null.

    ``closed="right"`` means (low, high], ``closed="left"`` means [low, high).
    """
    if closed == "right":
        cases = [((col > lo) & (col <= hi), label) for label, lo, hi in bounds]
    else:
        cases = [((col >= lo) & (col < hi), label) for label, lo, hi in bounds]
    return first_true(cases)


def level_rank(col: Column, levels: Sequence[str]) -> Column:
    """1-based rank of an ordered label; labels outside the list give null."""
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), col)
    return F.when(pos > 0, pos.cast("int"))


def stars(p: Column, blank_dot: bool = False) -> Column:
    """Significance marks with right-closed cut points .001, .01, .05 and .1."""
    return (
        F.when(p.isNull(), None)
        .when(p <= 0.001, "***")
        .when(p <= 0.01, "**")
        .when(p <= 0.05, "*")
        .when(p <= 0.1, " " if blank_dot else ".")
        .otherwise(" ")
    )


def normal_interval(mean: Column, sd: Column, z: float = 1.96) -> tuple[Column, Column]:
    return mean - z * sd, mean + z * sd
