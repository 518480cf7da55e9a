"""Scorecards from additive summaries: partial figures by finer keys, merged when asked.

A summary holds, per combination of its dimensions, counts, sums, extremes and, for
exact quantiles, how often each value occurs. A scorecard over any of the dimensions,
filtered by any of them, follows from it without a look at the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlag.operators import scorecard as sc
from flightlag.operators.benchmark import interpolated
from flightlag.operators.filters import Slice
from flightlag.operators.scorecard import Measure

# What a kind of measure needs to know of its input.
PARTS = {
    "rows": (),
    "total": ("sum",),
    "share": ("sum", "known"),
    "mean": ("sum", "known"),
    "largest": ("max",),
    "smallest": ("min",),
    "quantile": ("histogram",),
}
FIRST = {"sum": F.sum, "known": F.count, "max": F.max, "min": F.min}
MERGED = {"sum": F.sum, "known": F.sum, "max": F.max, "min": F.min}


def _entries(histogram: str) -> Column:
    """The entries of a histogram column, each with the column's name."""
    return F.transform(
        histogram,
        lambda x: F.struct(F.lit(histogram).alias("of"), x["value"].cast("double").alias("value"), x["n"].alias("n")),
    )


@dataclass(frozen=True)
class Summary:
    """Which figures are kept by which dimensions."""

    dims: tuple[str, ...]
    measures: tuple[Measure, ...]

    def _parts(self) -> dict[tuple[str, str], str]:
        """(part, input) to the column that holds it."""
        names: dict[tuple[str, str], str] = {}
        for m in self.measures:
            for part in PARTS[m.kind]:
                names.setdefault((part, str(m.input())), f"{part}_{len(names)}")
        return names

    def fits(self, columns: Sequence[str], measures: Sequence[Measure]) -> bool:
        """Whether figures by these columns can be told from the summary."""
        known = self._parts()
        wanted = [(part, str(m.input())) for m in measures if m.kind in PARTS for part in PARTS[m.kind]]
        return set(columns) <= set(self.dims) and all(m.kind in PARTS for m in measures) and set(wanted) <= set(known)

    def build(self, df: DataFrame) -> DataFrame:
        """The summary of ``df``: one row per combination of the dimensions.

        Rows are first counted per value of the quantiles' inputs, where map tasks
        combine; a histogram has an entry per value of the input in its group, so the
        input should be of a bounded domain, like whole minutes.
        """
        names = self._parts()
        inputs = {str(m.input()): m.input() for m in self.measures if m.kind != "rows"}
        points = {name: inputs[text] for (part, text), name in names.items() if part == "histogram"}
        plain = {name: FIRST[part](inputs[text]) for (part, text), name in names.items() if part != "histogram"}
        counted = df.withColumns(points).groupBy(*self.dims, *points).agg(
            F.count("*").alias("rows"), *[value.alias(name) for name, value in plain.items()]
        )
        if not points:
            return counted
        merged = [F.sum("rows").alias("rows")]
        for (part, _), name in names.items():
            if part == "histogram":
                bar = F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("value"), F.col("rows").alias("n")))
                merged.append(F.collect_list(bar).alias(name))
            else:
                merged.append(MERGED[part](name).alias(name))
        return counted.groupBy(*self.dims).agg(*merged)

    def answer(
        self, table: DataFrame, keys: Sequence[str], measures: Sequence[Measure], min_rows: int | None = None
    ) -> DataFrame:
        """The scorecard by ``keys`` from the rows of a built summary: one exchange."""
        names, keys = self._parts(), list(keys)

        def column(part: str, m: Measure) -> str:
            return names[part, str(m.input())]

        bars = sorted({column("histogram", m) for m in measures if m.kind == "quantile"})
        counts = F.lit(True)
        if bars:
            # Entries of all histograms in one list; other figures count with the first entry.
            entries = F.concat(*map(_entries, bars))
            wanted = {column(part, m) for m in measures for part in PARTS[m.kind] if part != "histogram"}
            table = table.select(*keys, "rows", *sorted(wanted - set(keys)), F.posexplode_outer(entries).alias("_place", "_entry"))
            counts = F.coalesce(F.col("_place") == 0, F.lit(True))
        out: dict[str, Column] = {"_rows": F.coalesce(F.sum(F.when(counts, F.col("rows"))), F.lit(0))}
        for i, m in enumerate(measures):
            for part in PARTS[m.kind]:
                if part == "histogram":
                    of = F.col("_entry.of") == column(part, m)
                    n = F.when(of, F.col("_entry.n")).otherwise(F.lit(0))
                    out[f"_q{i}"] = interpolated(F.when(of, F.col("_entry.value")), m.p, n)
                else:
                    value = MERGED[part](F.when(counts, F.col(column(part, m))))
                    out[f"_n{i}" if part == "known" else f"_s{i}"] = value
        grouped = table.groupBy(*keys).agg(*[value.alias(name) for name, value in out.items()])
        if min_rows is not None:
            grouped = grouped.filter(F.col("_rows") >= min_rows)
        return sc.finished(grouped, keys, measures)


@dataclass(frozen=True)
class Source:
    """A fact with the summary kept of it, if any; both are looked up when they are read.

    ``airport`` is the column that a slice's airports are matched with.
    """

    fact: Callable[[], DataFrame]
    summary: Summary | None = None
    table: Callable[[], DataFrame] | None = None
    airport: str = "origin"

    def figures(
        self, where: Slice, keys: Sequence[str], measures: Sequence[Measure], hours: tuple[int, int] | None = None
    ) -> DataFrame:
        """The scorecard of a slice: from the summary if that can tell it, else from the fact.

        ``hours`` keeps rows whose ``hour`` is in a range.
        """
        used = [*keys, *where.columns(self.airport), *(["hour"] if hours else [])]
        told = self.summary is not None and self.summary.fits(used, measures)
        rows = where.apply((self.table if told else self.fact)(), self.airport)
        if hours:
            rows = rows.filter(F.col("hour").between(*hours))
        return self.summary.answer(rows, keys, measures) if told else sc.scorecard(rows, keys, measures)
