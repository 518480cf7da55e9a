"""Grouped key figures: counts, rates, means, exact quantiles, distinct counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlag.functions.numeric import from_units, rate, ratio, round_to, whole_units
from flightlag.operators.benchmark import interpolated


@dataclass(frozen=True)
class Measure:
    """One output column. ``where`` limits the rows it looks at.

    ``places`` says the value is a decimal number of that many places: it is then
    summed in whole units, so the sum is exact and does not depend on the order
    in which tasks deliver it.
    """

    name: str
    kind: str
    value: Column | None = None
    where: Column | None = None
    digits: int | None = None
    p: float | None = None
    places: int | None = None

    def input(self) -> Column:
        value = self.value if self.places is None else whole_units(self.value, self.places)
        return value if self.where is None else F.when(self.where, value)


def rows(name: str) -> Measure:
    return Measure(name, "rows")


def total(name: str, value: Column, places: int | None = None) -> Measure:
    return Measure(name, "total", value, places=places)


def tally(name: str, flag: Column) -> Measure:
    """How many rows have the flag set."""
    return Measure(name, "total", flag.cast("int"))


def share(name: str, flag: Column, digits: int | None = None) -> Measure:
    """Percentage of rows with the flag set among those where it is known."""
    return Measure(name, "share", flag.cast("int"), digits=digits)


def mean(
    name: str,
    value: Column,
    where: Column | None = None,
    digits: int | None = None,
    places: int | None = None,
) -> Measure:
    return Measure(name, "mean", value, where, digits, places=places)


def quantile(
    name: str, value: Column, p: float, where: Column | None = None, digits: int | None = None
) -> Measure:
    return Measure(name, "quantile", value, where, digits, p)


def distinct(name: str, value: Column) -> Measure:
    return Measure(name, "distinct", value)


def largest(name: str, value: Column) -> Measure:
    return Measure(name, "largest", value)


def smallest(name: str, value: Column) -> Measure:
    return Measure(name, "smallest", value)


def scorecard(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Measure],
    min_rows: int | None = None,
) -> DataFrame:
    """Measures per key; groups with fewer than ``min_rows`` rows are left out.

    Sums are first taken per key and distinct quantile input, with map-side
    combining, so a group with a large part of all rows is spread over tasks and
    the exact quantile only sees a histogram.
    """
    keys = list(keys)
    points: dict[str, Column] = {}
    sums: dict[str, Column] = {"_rows": F.count("*")}
    point_of: dict[int, str] = {}
    names: dict[str, str] = {}
    for i, m in enumerate(measures):
        if m.kind in ("quantile", "distinct"):
            # Quantiles of one input share its histogram.
            point_of[i] = names.setdefault(str(m.input()), f"_p{i}")
            points[point_of[i]] = m.input()
        elif m.kind in ("total", "mean", "share"):
            sums[f"_s{i}"] = F.sum(m.input())
            if m.kind != "total":
                sums[f"_n{i}"] = F.count(m.input())
        elif m.kind in ("largest", "smallest"):
            sums[f"_s{i}"] = (F.max if m.kind == "largest" else F.min)(m.input())

    grouped = df.withColumns(points).groupBy(*keys, *points).agg(
        *[expr.alias(name) for name, expr in sums.items()]
    )
    if points:
        merged = []
        for name in sums:
            kind = measures[int(name[2:])].kind if name != "_rows" else "total"
            merge = {"largest": F.max, "smallest": F.min}.get(kind, F.sum)
            merged.append(merge(name).alias(name))
        for i, m in enumerate(measures):
            if m.kind == "quantile":
                merged.append(interpolated(F.col(point_of[i]), m.p, F.col("_rows")).alias(f"_q{i}"))
            elif m.kind == "distinct":
                merged.append(F.count_distinct(point_of[i]).alias(f"_q{i}"))
        grouped = grouped.groupBy(*keys).agg(*merged)
    if min_rows is not None:
        grouped = grouped.filter(F.col("_rows") >= min_rows)
    return finished(grouped, keys, measures)


def finished(grouped: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """Measures from their sums: _rows, and _s, _n or _q with the measure's number."""
    return grouped.select(*keys, *[_finish(i, m).alias(m.name) for i, m in enumerate(measures)])


def _sum(i: int, m: Measure) -> Column:
    return F.col(f"_s{i}") if m.places is None else from_units(F.col(f"_s{i}"), m.places)


def _finish(i: int, m: Measure) -> Column:
    if m.kind == "rows":
        return F.col("_rows")
    if m.kind == "share":
        out = rate(F.col(f"_s{i}"), F.col(f"_n{i}"))
    elif m.kind == "mean":
        out = ratio(_sum(i, m), F.col(f"_n{i}"))
    elif m.kind in ("quantile", "distinct"):
        out = F.col(f"_q{i}")
    else:
        out = _sum(i, m)
    return out if m.digits is None else round_to(out, m.digits)
