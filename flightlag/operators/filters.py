"""One filter object for every dataset of a report."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slice:
    """Carriers, airports and an inclusive date range; empty or None means all."""

    carriers: Sequence[str] = field(default_factory=tuple)
    airports: Sequence[str] = field(default_factory=tuple)
    date_from: dt.date | None = None
    date_to: dt.date | None = None

    def predicate(self, airport_column: str = "origin", by_month: bool = False) -> Column:
        """The filter as one column.

        ``by_month`` repeats the date range on the year and month columns, for
        tables whose files are laid out by month.
        """
        keep = F.lit(True)
        if self.carriers:
            keep = keep & F.col("carrier").isin(list(self.carriers))
        if self.airports:
            keep = keep & F.col(airport_column).isin(list(self.airports))
        month = F.col("year") * 12 + F.col("month") if by_month else None
        for day, at_least in ((self.date_from, True), (self.date_to, False)):
            if day is None:
                continue
            date = F.lit(day)
            keep = keep & (F.col("flight_date") >= date if at_least else F.col("flight_date") <= date)
            if month is not None:
                bound = day.year * 12 + day.month
                keep = keep & (month >= bound if at_least else month <= bound)
        return keep

    def columns(self, airport_column: str = "origin") -> list[str]:
        """Columns the filter looks at."""
        dated = self.date_from is not None or self.date_to is not None
        return ["carrier"] * bool(self.carriers) + [airport_column] * bool(self.airports) + ["flight_date"] * dated

    def apply(self, df: DataFrame, airport_column: str = "origin") -> DataFrame:
        by_month = {"year", "month"} <= set(df.columns)
        return df.filter(self.predicate(airport_column, by_month))

    @property
    def is_narrowed(self) -> bool:
        return bool(self.carriers or self.airports)

    def describe(self) -> str:
        parts = [", ".join(self.carriers) or "all carriers"]
        if self.airports:
            parts.append("via " + ", ".join(self.airports))
        if self.date_from or self.date_to:
            parts.append(f"{self.date_from or 'start'} to {self.date_to or 'end'}")
        return " · ".join(parts)
