"""Thresholds of the model, all overridable."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # Results depend on them.
    max_turn_minutes: int = 720
    min_sample: int = 100
    floor_quantile: float = 0.05
    tight_turn_minutes: int = 15
    on_time_minutes: int = 15
    route_min_flights: int = 500
    route_export_min_flights: int = 1000
    opportunity_min_turns: int = 2000
    ranking_min_flights: int = 200_000
    worst_day_min_chain: int = 3
    worst_day_rows: int = 60
    opportunity_rows: int = 40
    top_station_rows: int = 10
    longest_reported_chain: int = 8
    min_root_minutes: int = 1
    first_hour: int = 5
    last_hour: int = 22
    added_buffers: tuple[int, ...] = (5, 10, 15)
    ranked_buffer: int = 10
    cost_assumption: str = "block_minute_usd"
    prevented_share: float = 0.20
    prevention_hours: tuple[int, int] = (5, 11)
    prevention_years: int = 5

    # "floor" reads 0856 as 08:56; "round" rounds the hour (09:56).
    clock: str = "floor"
    # Columns that settle the order of legs leaving at the same instant.
    tie_break: tuple[str, ...] = (
        "carrier",
        "flight_number",
        "origin",
        "dest",
        "crs_dep_time",
    )
    # Legs of one aircraft a single task should sort; longer sequences are split.
    max_rows_per_sequence: int = 2_000_000
    # Carrier compared with all others in event and composition reports.
    focus_carrier: str = "WN"
    station_pairs: tuple[tuple[str, str], ...] = field(
        default=(("Delta Air Lines", "ATL"), ("Southwest Airlines", "DEN"))
    )
