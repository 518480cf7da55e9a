"""Delay split into the part that started here and the part that arrived."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero_filled(names: Sequence[str]) -> Column:
    """Sum of columns, each missing one counting as nothing."""
    total = F.lit(0)
    for name in names:
        total = total + F.coalesce(F.col(name), F.lit(0))
    return total.cast("int")


def split_root_inherited(
    df: DataFrame,
    controllable: Sequence[str] = ("carrier_delay",),
    external: Sequence[str] = ("weather_delay", "nas_delay", "security_delay"),
    inherited: str = "late_aircraft_delay",
) -> DataFrame:
    """Add root, inherited, controllable and external minutes."""
    return df.withColumns(
        {
            "root_delay_minutes": zero_filled([*controllable, *external]),
            "inherited_delay_minutes": zero_filled([inherited]),
            "controllable_root_minutes": zero_filled(controllable),
            "external_root_minutes": zero_filled(external),
        }
    )


def attribution_flags(df: DataFrame, causes: Sequence[str], marker: str) -> DataFrame:
    """Whether causes were reported, and whether any of them is positive."""
    reported = F.col(marker).isNotNull()
    return df.withColumns(
        {
            "has_cause_attribution": reported,
            "has_complete_attribution": reported
            & (F.greatest(*[F.col(c) for c in causes]) > 0),
        }
    )
