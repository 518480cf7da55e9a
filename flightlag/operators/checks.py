"""Assertions on data, evaluated together and returned as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Groups:
    """How many groups of equal ``keys`` there are among the rows that meet ``where``.

    Without ``nulls`` rows with a null in every key form no group, as in a distinct count.
    With ``counted`` only groups count whose number of rows meets it.
    """

    keys: Sequence[Column]
    where: Column | None = None
    counted: Callable[[Column], Column] | None = None
    nulls: bool = False

    def columns(self) -> list[Column]:
        """The keys, null where no group is wanted, and with ``nulls`` a mark that one is."""
        keys = [*self.keys, F.lit(True)] if self.nulls else self.keys
        return [k if self.where is None else F.when(self.where, k) for k in keys]

    def wanted(self, keys: Sequence[Column]) -> Column:
        return reduce(Column.__or__, [k.isNotNull() for k in (keys[-1:] if self.nulls else keys)])


@dataclass(frozen=True)
class Check:
    """What is observed and the bounds it must keep. Strict bounds exclude the ends.

    Observed is an aggregate of the rows, a number of groups, or what ``combined`` makes
    of both.
    """

    name: str
    observed: Column | None = None
    low: float | None = None
    high: float | None = None
    strict: bool = True
    groups: Groups | None = None
    combined: Callable[[Column, Column], Column] | None = None

    def bound(self) -> str:
        if self.low is not None and self.low == self.high:
            return f"= {self.low:g}"
        sign = "" if self.strict else "="
        parts = []
        if self.low is not None:
            parts.append(f">{sign} {self.low:g}")
        if self.high is not None:
            parts.append(f"<{sign} {self.high:g}")
        return " and ".join(parts)

    def passed(self, value: Column) -> Column:
        if self.low is not None and self.low == self.high:
            ok = value == F.lit(float(self.low))
        else:
            ok = F.lit(True)
            if self.low is not None:
                ok = ok & (value > self.low if self.strict else value >= self.low)
            if self.high is not None:
                ok = ok & (value < self.high if self.strict else value <= self.high)
        return F.coalesce(ok, F.lit(False))


def none(name: str, violation: Column) -> Check:
    """No row may satisfy ``violation``."""
    return Check(name, F.count_if(violation), 0, 0)


def equal(name: str, observed: Column, value: float) -> Check:
    return Check(name, observed, value, value)


def no_group(name: str, groups: Groups) -> Check:
    """No group may be one that counts."""
    return Check(name, low=0, high=0, groups=groups)


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks of one dataset, one row each, from one scan and one exchange of rows.

    Where checks look at groups, every row enters once for the whole and once per set of
    keys (grouping sets). Tasks combine before the exchange: the whole is then one row
    a task, so only keys with many values travel, and a hot key is one row a task too.
    A second exchange brings one row a task together.
    """
    groups = {f"_g{i}": c.groups for i, c in enumerate(checks) if c.groups is not None}
    totals = {f"_c{i}": c.observed for i, c in enumerate(checks) if c.observed is not None}
    if groups:
        observed = _with_groups(df, totals, groups)
    else:
        observed = df.agg(*[value.alias(name) for name, value in totals.items()])
    figures = []
    for i, c in enumerate(checks):
        value = F.col(f"_c{i}") if c.observed is not None else F.col(f"_g{i}")
        if c.combined is not None:
            value = c.combined(F.col(f"_c{i}"), F.col(f"_g{i}"))
        figures.append(F.round(value.cast("double"), 6).alias(f"_c{i}"))
    results = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("check_name"),
                F.col(f"_c{i}").alias("observed"),
                F.lit(c.bound()).alias("bound"),
                c.passed(F.col(f"_c{i}")).alias("passed"),
            )
            for i, c in enumerate(checks)
        ]
    )
    return observed.select(*figures).select(F.inline(results))


def _with_groups(df: DataFrame, totals: dict[str, Column], groups: dict[str, Groups]) -> DataFrame:
    """One row: the aggregates of the whole and the numbers of groups, by their names."""
    columns = {f"{name}_{j}": k for name, g in groups.items() for j, k in enumerate(g.columns())}
    keys = {name: [k for k in columns if k.startswith(f"{name}_")] for name in groups}
    rows = (
        df.withColumns(columns)
        .groupingSets([[], *[[F.col(k) for k in of_set] for of_set in keys.values()]], *columns)
        .agg(
            F.grouping_id().alias("_set"),
            F.count(F.lit(1)).alias("_rows"),
            *[value.alias(name) for name, value in totals.items()],
        )
    )
    # The aggregates over no rows, for an empty table; nothing is read for it.
    nothing = df.where(F.lit(False)).agg(F.lit(-1).cast("long").alias("_set"), *[v.alias(n) for n, v in totals.items()])
    # A bit of the set's number is on where the key, first ones highest, is not in it.
    bit = {name: 1 << at for at, name in enumerate(reversed(columns))}
    whole = (1 << len(columns)) - 1

    def of_whole(name: str) -> Column:
        found, without = (F.max(F.when(F.col("_set") == n, F.col(name))) for n in (whole, -1))
        return F.coalesce(found, without).alias(name)

    def number(name: str, g: Groups) -> Column:
        met = (F.col("_set") == whole - sum(bit[k] for k in keys[name])) & g.wanted([F.col(k) for k in keys[name]])
        return F.count_if(met if g.counted is None else met & g.counted(F.col("_rows"))).alias(name)

    return rows.unionByName(nothing, allowMissingColumns=True).agg(
        *[of_whole(name) for name in totals], *[number(name, g) for name, g in groups.items()]
    )


def combine(results: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)
