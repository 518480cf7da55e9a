"""Which figures of the facts are kept by day, so that filters need not read the facts."""

from __future__ import annotations

from flightlag.operators.buffer import curve_measures
from flightlag.operators.summary import Summary
from flightlag.plans.explore import damage_measures, kpi_measures
from flightlag.settings import Settings

DAY = ("year", "month", "flight_date", "carrier")


def flight_days() -> Summary:
    """A delay is whole minutes, so a day's histogram is short."""
    return Summary((*DAY, "origin"), tuple(kpi_measures()))


def cascade_hours() -> Summary:
    return Summary(("flight_date", "carrier", "root_origin", "hour"), tuple(damage_measures()))


def turn_hours(settings: Settings = Settings()) -> Summary:
    """For every buffer that is asked for."""
    measures = [m for added in settings.added_buffers for m in curve_measures(added)]
    return Summary((*DAY, "origin", "hour"), tuple(measures))
