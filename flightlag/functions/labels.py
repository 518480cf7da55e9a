"""Names given to codes, shares and mixtures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of the feed and the labels reports use.
CANCELLATION_REASONS = {
    "A": "Carrier",
    "B": "Weather",
    "C": "National Air System",
    "D": "Security",
}

# Lower bounds of the departure share, largest first.
SIZE_BANDS = [(0.0100, "Large"), (0.0025, "Medium"), (0.0005, "Small")]
SMALLEST_BAND = "Non-hub"

# Cause columns and labels, in the order that settles ties.
CAUSES_BY_PRIORITY = [
    ("carrier_delay", "Carrier"),
    ("late_aircraft_delay", "Late aircraft"),
    ("nas_delay", "National Air System"),
    ("weather_delay", "Weather"),
    ("security_delay", "Security"),
]
NO_CAUSE = "None reported"


def lookup(key: Column, labels: dict[str, str]) -> Column:
    """Label of a code from a short literal table; unknown codes give NULL."""
    table = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    return F.try_element_at(table, key)


def cancellation_reason(code: Column) -> Column:
    return lookup(code, CANCELLATION_REASONS)


def size_band(share: Column) -> Column:
    """Band of a share; a missing share falls in the smallest band."""
    band = F.lit(SMALLEST_BAND)
    for bound, name in reversed(SIZE_BANDS):
        band = F.when(share >= F.lit(bound), F.lit(name)).otherwise(band)
    return band


def dominant_category(
    amounts: Sequence[tuple[str, str]], known: Column, nothing: str = NO_CAUSE
) -> Column:
    """Label of the largest amount; equal amounts go to the earliest in the list.

    ``known`` says whether amounts were reported at all.
    """
    peak = F.greatest(*[F.col(name) for name, _ in amounts])
    winner = reduce(
        lambda later, pair: F.when(F.col(pair[0]) == peak, F.lit(pair[1])).otherwise(later),
        reversed(amounts),
        F.lit(None).cast("string"),
    )
    return F.when(known, F.when(peak == 0, F.lit(nothing)).otherwise(winner))


def primary_cause() -> Column:
    return dominant_category(CAUSES_BY_PRIORITY, F.col("late_aircraft_delay").isNotNull())
