"""SQL that must give the same rows as the query of the same name."""

from __future__ import annotations

from oracle import models  # noqa: F401  (defines the steps)
from oracle.chain import answer
from oracle.models import INHERITED_PCT, calendar_sql, exact_avg, floors_sql, pct, thanks_sql

ORACLES: dict[str, str] = {}


def oracle(name: str, columns: str, body: str) -> None:
    ORACLES[name] = answer(columns, body)


# ------------------------------------------------------------ sources and typing

AIRPORT_REF = "s:airport_code,airport_name,city,country d:latitude,longitude s:timezone"
oracle("airport_reference", AIRPORT_REF, "SELECT * FROM airport_ref")

EMPTY_TEXT = """carrier_dot_id,origin_airport_id,dest_airport_id,dep_time,wheels_off,wheels_on,taxi_in,
crs_arr_time,arr_time,distance_group""".replace("\n", "").split(",")
EMPTY_NAMES = """origin_city,origin_state,origin_state_name,dest_city,dest_state,dest_state_name,
dep_time_block,arr_time_block""".replace("\n", "").split(",")
FEED_INTS = (
    "year,quarter,month,day_of_month,day_of_week,flight_number,crs_dep_time,dep_delay,"
    "dep_delay_minutes,taxi_out,arr_delay,arr_delay_minutes,crs_elapsed_time,actual_elapsed_time,"
    "air_time,carrier_delay,weather_delay,nas_delay,security_delay,late_aircraft_delay"
)
oracle(
    "scan_csv_typed",
    f"i:{FEED_INTS} y:flight_date s:carrier,tail_number,origin,dest,cancellation_code "
    f"b:dep_del15,arr_del15,cancelled,diverted d:distance_miles "
    f"i:{','.join(EMPTY_TEXT)} s:{','.join(EMPTY_NAMES)}",
    f"SELECT *, {', '.join(f'NULL AS {c}' for c in EMPTY_TEXT + EMPTY_NAMES)} FROM feed",
)
oracle(
    "typed_projection",
    "i:event_id,as_int,as_hhmm,as_minutes d:as_num b:as_bool s:as_str y:as_date",
    """
SELECT event_id, try_cast(x AS INT) AS as_int, try_cast(x AS INT) AS as_hhmm,
       try_cast(try_cast(x AS DOUBLE) AS INT) AS as_minutes, try_cast(x AS DOUBLE) AS as_num,
       try_cast(x AS DOUBLE) = 1 AS as_bool, nullif(trim(x), '') AS as_str,
       if(event_id % 3 = 0, NULL, CAST(ts AS DATE)) AS as_date
FROM (SELECT *, CASE event_id % 7
        WHEN 0 THEN CAST(floor(value) AS INT) || '.00' WHEN 1 THEN ' ' || CAST(floor(value) AS INT) || ' '
        WHEN 2 THEN '' WHEN 3 THEN event_type WHEN 4 THEN lpad(CAST(event_id % 2400 AS VARCHAR), 4, '0')
        WHEN 5 THEN '   ' ELSE if(value >= 20, '1.00', '0.00') END AS x
      FROM events)
""",
)
oracle(
    "scan_partitioned",
    "i:year,month,flights y:first_day,last_day i:arr_delay_sum d:miles",
    """
SELECT year, month, count(*) AS flights, min(flight_date) AS first_day, max(flight_date) AS last_day,
       sum(arr_delay) AS arr_delay_sum, sum(distance_miles) AS miles
FROM feed GROUP BY year, month
""",
)
oracle(
    "months_to_ingest",
    "i:year,month s:status",
    """
SELECT year(m) AS year, month(m) AS month,
       CASE WHEN m = lo THEN 'stored' WHEN m <= hi THEN 'to_ingest' ELSE 'missing' END AS status
FROM (SELECT *, unnest(generate_series(lo, hi + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m
      FROM (SELECT date_trunc('month', min(flight_date))::TIMESTAMP AS lo,
                   date_trunc('month', max(flight_date))::TIMESTAMP AS hi FROM feed))
""",
)
oracle(
    "ingest_month",
    "i:year,month,rows",
    "SELECT year, month, count(*) AS rows FROM feed GROUP BY year, month",
)
oracle(
    "landed_months",
    "i:year,month,rows",
    "SELECT year, month, count(*) AS rows FROM feed GROUP BY year, month",
)
oracle(
    "inline_reference",
    "s:assumption d:value i:inherited_minutes d:usd",
    """
SELECT assumption, value, minutes AS inherited_minutes, minutes * value AS usd
FROM (VALUES ('block_minute_usd', 98.41::DECIMAL(5,2)), ('block_minute_usd_2024', 100.76::DECIMAL(5,2)))
     AS r(assumption, value),
     (SELECT sum(inherited_delay_minutes)::BIGINT AS minutes FROM flights)
""",
)
CALENDAR = (
    "y:date_day i:year,quarter,month s:month_name i:day_of_month,iso_day_of_week s:day_name "
    "b:is_weekend s:holiday_name b:is_federal_holiday s:travel_period"
)
oracle(
    "calendar",
    CALENDAR,
    calendar_sql(
        "SELECT min(o_orderdate)::DATE::TIMESTAMP AS lo, max(o_orderdate)::DATE::TIMESTAMP AS hi FROM orders"
    ),
)
oracle(
    "range_join_periods",
    "s:label i:period_year,orders,cents",
    f"""
SELECT w.label, w.y AS period_year, count(*) AS orders, sum(round(o_totalprice * 100)::BIGINT) AS cents
FROM orders o LEFT JOIN (
    SELECT y, 'Thanksgiving' AS label, {thanks_sql('y')} AS t
    FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)) w
  ON CAST(o.o_orderdate AS DATE) BETWEEN w.t - 2 AND w.t + 4
GROUP BY w.label, w.y
""",
)

# ------------------------------------------------------------------ flight facts

oracle(
    "stg_flight",
    "i:event_id s:origin,dest,origin_tz,dest_tz i:sched_dep_local,sched_dep_utc b:is_schedule_valid "
    "i:sched_arr_utc,actual_dep_utc,actual_arr_utc",
    "SELECT * FROM flights",
)
oracle(
    "stg_flight_rounded_clock",
    "i:event_id,crs_dep_time,sched_dep_hour_local,sched_dep_utc,sched_arr_utc",
    """
SELECT *, if(crs_elapsed_time > 0, sched_dep_utc + crs_elapsed_time, NULL) AS sched_arr_utc
FROM (SELECT event_id, crs_dep_time, crs_elapsed_time,
             CAST(crs_dep_time / 100 AS BIGINT) AS sched_dep_hour_local,
             epoch((flight_date + to_minutes(CAST(crs_dep_time / 100 AS BIGINT) * 60 + crs_dep_time % 100))
                   AT TIME ZONE origin_tz) // 60 AS sched_dep_utc FROM feed)
""",
)
oracle(
    "fct_flight",
    "y:flight_date s:carrier i:flight_number s:tail_number,origin,dest i:quarter,day_of_week,sched_dep_utc,"
    "sched_arr_utc,actual_dep_utc,actual_arr_utc,sched_dep_local,crs_dep_time b:cancelled "
    "s:cancellation_code b:diverted,is_schedule_valid i:dep_delay,dep_delay_minutes b:dep_del15 "
    "i:arr_delay,arr_delay_minutes b:arr_del15 i:taxi_out,crs_elapsed_time,actual_elapsed_time,air_time "
    "d:distance_miles i:carrier_delay,weather_delay,nas_delay,security_delay,late_aircraft_delay,year,month,"
    "event_id s:route i:sched_dep_hour_local s:cancellation_reason b:completed,is_on_time_a14 "
    "i:block_time_variance s:primary_cause b:has_cause_attribution,has_complete_attribution "
    "i:root_delay_minutes,inherited_delay_minutes,controllable_root_minutes,external_root_minutes",
    "SELECT * FROM flights",
)
oracle(
    "delay_split",
    "i:event_id s:tail_number i:root_delay_minutes,inherited_delay_minutes,controllable_root_minutes,"
    "external_root_minutes b:has_cause_attribution,has_complete_attribution",
    "SELECT * FROM flights",
)
oracle(
    "primary_cause",
    "s:carrier,primary_cause i:flights,delay_minutes",
    """
SELECT carrier, primary_cause, count(*) AS flights, sum(arr_delay_minutes) AS delay_minutes
FROM flights GROUP BY carrier, primary_cause
""",
)
oracle(
    "cancellation_reason",
    "s:cancellation_code,cancellation_reason i:flights",
    "SELECT cancellation_code, cancellation_reason, count(*) AS flights FROM flights GROUP BY ALL",
)
oracle(
    "flyable_legs",
    "i:event_id s:tail_number,origin,dest i:sched_dep_utc,actual_arr_utc",
    """
SELECT * FROM flights
WHERE completed AND crs_elapsed_time > 0 AND tail_number <> 'UNKNOW'
  AND regexp_full_match(tail_number, 'N[0-9][0-9A-Z]{1,4}')
""",
)

# -------------------------------------------------------------------- dimensions

oracle("airport_activity", "s:airport_code i:departures,arrivals", "SELECT * FROM activity")
oracle(
    "dim_airport",
    f"{AIRPORT_REF} i:departures,arrivals d:departure_share s:size_band b:is_mapped",
    "SELECT * FROM airports",
)
oracle(
    "dim_carrier",
    "s:carrier,carrier_name,carrier_type,operates_for b:is_mapped i:flights y:first_seen,last_seen",
    "SELECT * FROM carriers",
)
oracle("dim_date", CALENDAR, "SELECT * FROM dates")

# ---------------------------------------------------------------------- rotation

oracle(
    "leg_sequence",
    "i:event_id s:tail_number i:leg_seq s:prev_dest,prev_carrier y:prev_flight_date i:prev_flight_number "
    "s:prev_origin i:prev_sched_arr_utc,prev_actual_arr_utc,prev_arr_delay,prev_root_delay_minutes,"
    "prev_inherited_delay_minutes s:prev_primary_cause",
    "SELECT * FROM sequenced",
)
oracle(
    "rotation_links",
    "i:event_id s:tail_number i:sched_turn_minutes,actual_turn_minutes b:is_continuation",
    "SELECT * FROM links",
)
LINKED = (
    "i:event_id s:tail_number i:leg_seq s:prev_dest,prev_carrier y:prev_flight_date i:prev_flight_number "
    "s:prev_origin i:prev_sched_arr_utc,prev_actual_arr_utc,prev_arr_delay,prev_root_delay_minutes,"
    "prev_inherited_delay_minutes s:prev_primary_cause i:sched_turn_minutes,actual_turn_minutes b:is_continuation,"
    "is_inheriting i:cascade_id,cascade_position,cascade_length"
)
oracle("rotation_by_month", LINKED, "SELECT * FROM legs")
oracle("rotation_by_ten_days", LINKED, "SELECT * FROM legs")
FLOORS = "s:carrier,airport i:sample_size d:min_turn_minutes s:benchmark_level"
oracle("min_turn", FLOORS, "SELECT * FROM floors")
oracle(
    "min_turn_network",
    "s:carrier,origin i:sample_size d:min_turn_minutes s:benchmark_level",
    f"SELECT *, airport AS origin FROM ({floors_sql(10**12)})",
)
oracle(
    "turn_slack",
    "i:event_id s:tail_number d:min_turn_minutes s:benchmark_level d:turn_slack_minutes,"
    "predicted_inherited_minutes,inherited_prediction_error",
    "SELECT * FROM legs",
)
oracle(
    "cascade_islands",
    "i:event_id s:tail_number b:is_inheriting i:cascade_id,cascade_position,cascade_length",
    "SELECT * FROM legs",
)

# ------------------------------------------------------------------------- marts

oracle(
    "carrier_monthly",
    "i:year,month y:month_start s:carrier,carrier_name,carrier_type i:scheduled_flights,completed_flights,"
    "cancelled_flights,diverted_flights d:on_time_arrival_pct,completion_factor_pct,cancellation_rate_pct,"
    "avg_arr_delay_minutes,median_arr_delay_minutes,p90_arr_delay_minutes i:root_delay_minutes,"
    "inherited_delay_minutes,controllable_root_minutes,external_root_minutes d:inherited_share_pct,"
    "avg_block_variance_minutes",
    "SELECT * FROM monthly",
)
oracle(
    "csv_file",
    "i:year,month y:month_start s:carrier,carrier_name,carrier_type i:scheduled_flights,completed_flights,"
    "cancelled_flights,diverted_flights d:on_time_arrival_pct,completion_factor_pct,cancellation_rate_pct,"
    "avg_arr_delay_minutes,median_arr_delay_minutes,p90_arr_delay_minutes i:root_delay_minutes,"
    "inherited_delay_minutes,controllable_root_minutes,external_root_minutes d:inherited_share_pct,"
    "avg_block_variance_minutes",
    "SELECT * FROM monthly",
)
DAILY = (
    "y:flight_date s:airport_code,city,size_band,travel_period b:is_federal_holiday s:day_name "
    "i:departures,carriers_operating,cancellations d:cancellation_rate_pct,departures_delayed_pct,"
    "avg_dep_delay_minutes,p90_dep_delay_minutes,avg_taxi_out_minutes i:root_delay_minutes,"
    "inherited_delay_minutes"
)
oracle("airport_daily", DAILY, "SELECT * FROM daily")
ROUTES = (
    "s:route,origin,dest,origin_city,dest_city,origin_size_band,carrier,carrier_name i:flights "
    "d:distance_miles,avg_scheduled_block_minutes,on_time_arrival_pct,cancellation_rate_pct,"
    "avg_arr_delay_minutes,p90_arr_delay_minutes,avg_block_variance_minutes,avg_air_time_minutes "
    "i:root_delay_minutes,inherited_delay_minutes"
)
oracle("route_reliability", ROUTES, "SELECT * FROM routes")
oracle(
    "cascade",
    "s:tail_number i:cascade_id s:carrier y:flight_date s:root_origin,root_dest i:root_sched_dep_utc,"
    "root_dep_hour_local,root_arr_delay,root_delay_minutes,root_controllable_minutes,root_external_minutes "
    "s:root_primary_cause,carrier_name,carrier_type i:downstream_legs,downstream_delay_minutes,"
    "downstream_stations_touched,total_cascade_minutes d:amplification_ratio,total_cascade_cost_usd",
    "SELECT * FROM cascades",
)
oracle(
    "buffer_simulation",
    "s:carrier,carrier_name,airport_code,city,size_band i:turns d:median_sched_turn_minutes,"
    "min_feasible_turn_minutes,median_slack_minutes,tight_turn_pct i:actual_inherited_minutes "
    "d:minutes_saved_plus_5,minutes_saved_plus_10,minutes_saved_plus_15,efficiency_plus_10,"
    "delay_cost_avoided_usd_plus_10 s:benchmark_level",
    "SELECT * FROM opportunities",
)

# ---------------------------------------------------------------------- analyses

oracle(
    "scope",
    "i:flights,carriers,airports,airframes y:first_day,last_day d:a14_pct,completion_pct,cancellation_pct,"
    "mean_arr_delay,p90_arr_delay",
    f"""
SELECT count(*) AS flights, count(DISTINCT carrier) AS carriers, count(DISTINCT origin) AS airports,
       count(DISTINCT tail_number) AS airframes, min(flight_date) AS first_day, max(flight_date) AS last_day,
       {pct('is_on_time_a14')} AS a14_pct, {pct('completed')} AS completion_pct,
       {pct('cancelled')} AS cancellation_pct, avg(arr_delay) AS mean_arr_delay,
       quantile_cont(arr_delay, 0.9) AS p90_arr_delay
FROM flights
""",
)
oracle(
    "inherited_share",
    "i:root_minutes,inherited_minutes,total_minutes d:inherited_pct,root_pct,inherited_cost_usd",
    """
SELECT *, r AS root_minutes, h AS inherited_minutes, r + h AS total_minutes, 100.0 * h / (r + h) AS inherited_pct,
       100.0 * r / (r + h) AS root_pct, h * 98.41::DECIMAL(5,2) AS inherited_cost_usd
FROM (SELECT sum(root_delay_minutes)::BIGINT AS r, sum(inherited_delay_minutes)::BIGINT AS h FROM flights)
""",
)
oracle(
    "model_validation",
    "i:turns d:mean_predicted,mean_reported,correlation",
    f"""
SELECT count(*) AS turns, {exact_avg('predicted_inherited_minutes', 6)} AS mean_predicted,
       avg(inherited_delay_minutes) AS mean_reported,
       corr(predicted_inherited_minutes, inherited_delay_minutes) AS correlation
FROM legs WHERE is_continuation AND prev_arr_delay > 15
""",
)
LATE_TURNS = """
(SELECT *, 15 * CAST(least(floor(turn_slack_minutes / 15), 6) AS BIGINT) AS slack_floor FROM legs
 WHERE is_continuation AND prev_arr_delay BETWEEN 30 AND 60)
"""
oracle(
    "slack_response",
    "i:slack_floor,turns d:avg_inherited,pct_late",
    f"""
SELECT slack_floor, count(*) AS turns, avg(inherited_delay_minutes) AS avg_inherited,
       {pct('dep_delay >= 15')} AS pct_late FROM {LATE_TURNS} GROUP BY slack_floor
""",
)
oracle(
    "slack_composition",
    "i:slack_floor,turns d:carrier_pct,cascade_pct",
    f"""
SELECT slack_floor, count(*) AS turns, {pct("carrier = 'WN'")} AS carrier_pct,
       {pct('cascade_position > 0')} AS cascade_pct FROM {LATE_TURNS} GROUP BY slack_floor
""",
)
HOURLY = "i:hour,roots d:legs,minutes,amplification"
oracle("cascade_by_hour", HOURLY, "SELECT * FROM damage")
oracle("buffer_by_hour", "i:hour,turns d:efficiency", "SELECT * FROM repair")
oracle(
    "hour_extremes",
    "i:peak_hour,trough_hour d:peak_to_trough i:amplification_hour d:peak_amplification i:best_buffer_hour "
    "d:best_efficiency,morning_efficiency,amplification_at_best",
    """
SELECT *, (SELECT amplification FROM damage WHERE hour = best_buffer_hour) AS amplification_at_best
FROM (SELECT first(hour ORDER BY legs DESC, hour) AS peak_hour, first(hour ORDER BY legs, hour) AS trough_hour,
             max(legs) / nullif(min(legs), 0) AS peak_to_trough,
             first(hour ORDER BY amplification DESC, hour) AS amplification_hour,
             max(amplification) AS peak_amplification FROM damage),
     (SELECT first(hour ORDER BY efficiency DESC, hour) AS best_buffer_hour, max(efficiency) AS best_efficiency,
             avg(efficiency) FILTER (WHERE hour <= 8) AS morning_efficiency FROM repair)
""",
)
oracle(
    "prevention_value",
    "i:controllable_minutes d:mean_amplification,network_minutes_saved,usd_saved_per_year",
    f"""
SELECT c AS controllable_minutes, a AS mean_amplification, 0.2::DOUBLE * c * a AS network_minutes_saved,
       0.2::DOUBLE * c * a * 98.41::DOUBLE / 5 AS usd_saved_per_year
FROM (SELECT sum(root_controllable_minutes) AS c, {exact_avg('amplification_ratio', 2)} AS a
      FROM cascades WHERE root_dep_hour_local BETWEEN 5 AND 11)
""",
)
WEIGHTED_A14 = "sum(scheduled_flights * CAST(round(on_time_arrival_pct * 100) AS BIGINT)) / 1e2 / sum(scheduled_flights)"
RANKING = f"""
SELECT carrier_name, carrier_type, sum(scheduled_flights) AS flights, {WEIGHTED_A14} AS a14_pct,
       {INHERITED_PCT} AS inherited_pct
FROM monthly GROUP BY carrier_name, carrier_type HAVING sum(scheduled_flights) > 100
"""
oracle("carrier_ranking", "s:carrier_name,carrier_type i:flights d:a14_pct,inherited_pct", RANKING)
oracle(
    "carrier_station_slack",
    "s:carrier_name,airport_code d:median_slack_minutes,tight_turn_pct",
    """
SELECT * FROM opportunities
WHERE carrier_name = 'Delta Air Lines' AND airport_code = 'ATL'
   OR carrier_name = 'Southwest Airlines' AND airport_code = 'DEN'
""",
)
EVENT = f"""
SELECT flight_date, 100.0 * avg(if(carrier = 'WN', cancelled::INT, NULL)) AS event_pct,
       100.0 * avg(if(carrier <> 'WN', cancelled::INT, NULL)) AS control_pct
FROM flights GROUP BY flight_date
"""
oracle(
    "event_vs_control",
    "y:flight_date d:event_pct,control_pct b:is_peak",
    f"""
SELECT *, row_number() OVER (ORDER BY event_pct DESC NULLS LAST, flight_date) = 1 AS is_peak FROM ({EVENT})
""",
)
LENGTHS = """
SELECT downstream_legs AS length, count(*) AS cascades, avg(downstream_delay_minutes) AS avg_minutes
FROM cascades WHERE downstream_legs <= 8 GROUP BY 1
"""
oracle("cascade_length", "i:length,cascades d:avg_minutes", LENGTHS)
TOP_TEN = """
SELECT carrier_name AS carrier, airport_code AS station, city, turns, median_slack_minutes AS slack,
       tight_turn_pct AS tight, minutes_saved_plus_10 AS saved,
       delay_cost_avoided_usd_plus_10 / 1e6 AS cost_musd
FROM (SELECT *, row_number() OVER (ORDER BY minutes_saved_plus_10 DESC, carrier, airport_code) AS place
      FROM opportunities) WHERE place <= 10
"""
oracle("top_stations", "s:carrier,station,city i:turns d:slack,tight,saved,cost_musd", TOP_TEN)
oracle(
    "top_stations_by_5",
    "s:carrier,station,city i:turns d:slack,tight,saved,cost_musd",
    TOP_TEN.replace("minutes_saved_plus_10", "minutes_saved_plus_5").replace(
        "delay_cost_avoided_usd_plus_10 / 1e6", "round(minutes_saved_plus_5 * 98.41, 0) / 1e6"
    ),
)
TREND = f"""
SELECT month_start, {WEIGHTED_A14} AS a14_pct, {INHERITED_PCT} AS inherited_pct
FROM monthly GROUP BY month_start
"""
oracle("monthly_trend", "y:month_start d:a14_pct,inherited_pct", TREND)
oracle(
    "turn_cutoff_sensitivity",
    "i:max_turn_minutes,turns,inherited_minutes",
    """
SELECT c AS max_turn_minutes, count(tail_number) AS turns, coalesce(sum(inherited_delay_minutes), 0) AS inherited_minutes
FROM (SELECT unnest([180, 360, 540, 720, 1080, 1440]) AS c)
LEFT JOIN links ON prev_dest = origin AND sched_turn_minutes BETWEEN 0 AND c
GROUP BY c
""",
)
oracle(
    "pilot_baseline",
    "s:carrier,airport_code i:departures,days,late d:late_share,departures_per_day i:sample_per_arm",
    """
SELECT *, ceil((1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) ** 2
               * (late_share * (1 - late_share) + lower * (1 - lower))
               / nullif((late_share - lower) ** 2, 0)) AS sample_per_arm
FROM (SELECT *, greatest(late_share - 0.05::DOUBLE, 0::DOUBLE) AS lower
      FROM (SELECT carrier, origin AS airport_code, count(*) AS departures,
                   count(DISTINCT flight_date) AS days, count_if(dep_delay >= 15) AS late,
                   count_if(dep_delay >= 15) / count(*) AS late_share,
                   count(*) / count(DISTINCT flight_date) AS departures_per_day
            FROM flights WHERE sched_dep_hour_local BETWEEN 5 AND 10 AND dep_delay IS NOT NULL
            GROUP BY carrier, origin))
""",
)
def arm_mean(where: str) -> str:
    return exact_avg(f"if({where}, departures_delayed_pct, NULL)", 2)


oracle(
    "difference_in_differences",
    "d:treated_before,treated_after,control_before,control_after,effect",
    f"""
SELECT *, (treated_after - treated_before) - (control_after - control_before) AS effect FROM (
  SELECT {arm_mean('t AND NOT a')} AS treated_before, {arm_mean('t AND a')} AS treated_after,
         {arm_mean('NOT t AND NOT a')} AS control_before, {arm_mean('NOT t AND a')} AS control_after
  FROM (SELECT *, airport_code IN ('ATL', 'DEN', 'DFW') AS t, flight_date >= DATE '2024-01-16' AS a FROM daily))
""",
)

# ----------------------------------------------------------------------- exports

oracle("export_airport_daily", DAILY, "SELECT * FROM daily WHERE size_band IN ('Large', 'Medium')")
oracle("export_route_reliability", ROUTES, "SELECT * FROM routes WHERE flights >= 40")
oracle(
    "export_cascade_by_hour",
    "i:dep_hour s:carrier,carrier_name,carrier_type i:root_delays d:avg_downstream_legs,"
    "avg_downstream_minutes,avg_amplification i:total_cascade_minutes d:total_cascade_cost_usd",
    f"""
SELECT root_dep_hour_local AS dep_hour, carrier, carrier_name, carrier_type, count(*) AS root_delays,
       round(avg(downstream_legs), 3) AS avg_downstream_legs,
       round(avg(downstream_delay_minutes), 2) AS avg_downstream_minutes,
       round({exact_avg('amplification_ratio', 2)}, 3) AS avg_amplification,
       sum(total_cascade_minutes) AS total_cascade_minutes,
       round(sum(total_cascade_cost_usd), 0) AS total_cascade_cost_usd
FROM cascades GROUP BY ALL
""",
)
oracle(
    "export_cascade_length",
    "i:cascade_length s:carrier_type i:cascades d:avg_downstream_minutes,avg_amplification",
    f"""
SELECT downstream_legs AS cascade_length, carrier_type, count(*) AS cascades,
       round(avg(downstream_delay_minutes), 1) AS avg_downstream_minutes,
       round({exact_avg('amplification_ratio', 2)}, 3) AS avg_amplification
FROM cascades GROUP BY ALL
""",
)
oracle(
    "export_buffer_by_hour",
    "i:turn_hour s:carrier i:turns d:predicted_inherited_base,predicted_inherited_plus_10,buffer_efficiency",
    f"""
SELECT turn_hour, carrier, turns, round(b, 0) AS predicted_inherited_base,
       round(w, 0) AS predicted_inherited_plus_10, round((b - w) / (10.0 * turns), 4) AS buffer_efficiency
FROM (SELECT sched_dep_hour_local AS turn_hour, carrier, count(*) AS turns,
             {models.passed_on(0)} AS b, {models.passed_on(10)} AS w
      FROM legs WHERE is_continuation GROUP BY ALL)
""",
)


def long_form(series: str, item: str, measures: dict[str, str], source: str) -> str:
    """(series, item, measure, value) rows of a relation."""
    names = ", ".join(f"'{m}'" for m in measures)
    values = ", ".join(f"CAST({e} AS DOUBLE)" for e in measures.values())
    return (
        f"SELECT '{series}' AS series, {item} AS item, unnest([{names}]) AS measure, "
        f"unnest([{values}]) AS value FROM ({source})"
    )


META = f"""
SELECT * FROM
 (SELECT count(*) AS flights, count(DISTINCT carrier) AS carriers, count(DISTINCT origin) AS airports,
         count(DISTINCT tail_number) AS airframes, min(flight_date) AS lo, max(flight_date) AS hi,
         100.0 * avg(is_on_time_a14::INT) AS a14, 100.0 * avg(completed::INT) AS done,
         100.0 * avg(cancelled::INT) AS lost, avg(arr_delay) AS mean_delay,
         quantile_cont(arr_delay, 0.9) AS p90, sum(root_delay_minutes)::DOUBLE AS r,
         sum(inherited_delay_minutes)::DOUBLE AS h FROM flights),
 (SELECT count(*) AS n, {exact_avg('predicted_inherited_minutes', 6)} AS p, avg(inherited_delay_minutes) AS q,
         corr(predicted_inherited_minutes, inherited_delay_minutes) AS c
  FROM legs WHERE is_continuation AND prev_arr_delay > 15)
"""
oracle(
    "dashboard_payload",
    "s:series,item,measure d:value",
    "\nUNION ALL\n".join(
        [
            long_form(
                "meta",
                "lo || '|' || hi",
                {
                    "flights": "flights", "carriers": "carriers", "airports": "airports",
                    "airframes": "airframes", "a14": "round(a14, 2)", "completion": "round(done, 2)",
                    "cancel": "round(lost, 2)", "mean_delay": "round(mean_delay, 1)",
                    "p90_delay": "round(p90, 0)", "root_m": "round(r / 1e6, 1)",
                    "inherited_m": "round(h / 1e6, 1)", "inherited_pct": "round(100 * h / (r + h), 1)",
                    "inherited_cost_bn": "round(h * 98.41::DOUBLE / 1e9, 2)", "corr": "round(c, 3)",
                    "model_pred": "round(p, 1)", "model_reported": "round(q, 1)", "model_turns": "n",
                    "block_minute_usd": "98.41",
                },
                META,
            ),
            long_form(
                "cascade_by_hour", "hour::VARCHAR",
                {"roots": "roots", "legs": "round(legs, 3)", "minutes": "round(minutes, 1)",
                 "amplification": "round(amplification, 3)"},
                "SELECT * FROM damage",
            ),
            long_form(
                "buffer_by_hour", "hour::VARCHAR",
                {"turns": "turns", "efficiency": "round(efficiency, 4)"}, "SELECT * FROM repair",
            ),
            long_form(
                "slack_response", "slack_floor::VARCHAR",
                {"turns": "turns", "avg_inherited": "round(x, 1)", "pct_late": "round(y, 1)"},
                f"SELECT slack_floor, count(*) AS turns, avg(inherited_delay_minutes) AS x,"
                f" {pct('dep_delay >= 15')} AS y FROM {LATE_TURNS} GROUP BY slack_floor",
            ),
            long_form(
                "cascade_length", "length::VARCHAR",
                {"cascades": "cascades", "avg_minutes": "round(avg_minutes, 1)"}, LENGTHS,
            ),
            long_form(
                "carriers", "carrier_name || '|' || carrier_type",
                {"flights": "flights", "a14": "round(a14_pct, 2)", "inherited_pct": "round(inherited_pct, 1)"},
                RANKING,
            ),
            long_form(
                "stations", "carrier || '|' || station || '|' || city",
                {"turns": "turns", "slack": "slack", "tight": "tight", "saved": "round(saved, 6)",
                 "cost_musd": "round(cost_musd, 1)"},
                TOP_TEN,
            ),
            long_form(
                "event", "flight_date::VARCHAR",
                {"event_pct": "round(event_pct, 1)", "control_pct": "round(control_pct, 1)"}, EVENT,
            ),
            long_form(
                "monthly", "month_start::DATE::VARCHAR",
                {"a14": "round(a14_pct, 2)", "inherited_pct": "round(inherited_pct, 1)"}, TREND,
            ),
        ]
    ),
)

# ------------------------------------------------------------------- interactive

NARROW = "carrier IN ('AA', 'WN', 'OO') AND {airport} IN ('ATL', 'DEN', 'ORD', 'HNL')"
BY_ORIGIN = NARROW.format(airport="origin")
THE_WEEK = "flight_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-14'"
IN_WEEK = f"{BY_ORIGIN} AND {THE_WEEK}"
oracle(
    "filter_domain",
    "s:kind,code,label,detail i:volume",
    """
SELECT 'carrier' AS kind, carrier AS code, carrier_name AS label, carrier_type AS detail, flights AS volume
FROM carriers
UNION ALL
SELECT 'airport', airport_code, city, size_band, departures FROM airports WHERE size_band <> 'Non-hub'
UNION ALL
SELECT 'span', 'flight_date', min(flight_date)::VARCHAR, max(flight_date)::VARCHAR, NULL FROM flights
""",
)
oracle(
    "filtered_kpis",
    "i:flights d:a14_pct,completion_pct,cancellation_pct,mean_arr_delay,p90_arr_delay i:root_minutes,"
    "inherited_minutes d:inherited_pct,inherited_cost_usd",
    f"""
SELECT *, 100.0 * inherited_minutes / nullif(root_minutes + inherited_minutes, 0) AS inherited_pct,
       inherited_minutes * 98.41::DOUBLE AS inherited_cost_usd
FROM (SELECT count(*) AS flights, {pct('is_on_time_a14')} AS a14_pct, {pct('completed')} AS completion_pct,
             {pct('cancelled')} AS cancellation_pct, avg(arr_delay) AS mean_arr_delay,
             quantile_cont(arr_delay, 0.9) AS p90_arr_delay, sum(root_delay_minutes) AS root_minutes,
             sum(inherited_delay_minutes) AS inherited_minutes
      FROM flights WHERE {BY_ORIGIN})
""",
)
oracle(
    "filtered_trend",
    "y:month_start d:a14_pct,inherited_pct",
    f"""
SELECT date_trunc('month', flight_date) AS month_start, {pct('is_on_time_a14')} AS a14_pct,
       {INHERITED_PCT} AS inherited_pct
FROM flights WHERE {BY_ORIGIN} GROUP BY 1
""",
)
oracle(
    "filtered_kpis_week",
    "i:flights d:a14_pct,completion_pct,cancellation_pct,mean_arr_delay,p90_arr_delay i:root_minutes,"
    "inherited_minutes d:inherited_pct,inherited_cost_usd",
    f"""
SELECT *, 100.0 * inherited_minutes / nullif(root_minutes + inherited_minutes, 0) AS inherited_pct,
       inherited_minutes * 98.41::DOUBLE AS inherited_cost_usd
FROM (SELECT count(*) AS flights, {pct('is_on_time_a14')} AS a14_pct, {pct('completed')} AS completion_pct,
             {pct('cancelled')} AS cancellation_pct, avg(arr_delay) AS mean_arr_delay,
             quantile_cont(arr_delay, 0.9) AS p90_arr_delay, sum(root_delay_minutes) AS root_minutes,
             sum(inherited_delay_minutes) AS inherited_minutes
      FROM flights WHERE {IN_WEEK})
""",
)
oracle(
    "filtered_trend_week",
    "y:month_start d:a14_pct,inherited_pct",
    f"""
SELECT date_trunc('month', flight_date) AS month_start, {pct('is_on_time_a14')} AS a14_pct,
       {INHERITED_PCT} AS inherited_pct
FROM flights WHERE {IN_WEEK} GROUP BY 1
""",
)
oracle(
    "one_aircraft_day",
    "s:tail_number y:flight_date i:leg_seq s:origin,dest i:arr_delay b:is_continuation",
    "SELECT * FROM legs WHERE tail_number = 'N107' AND flight_date = DATE '2024-01-09'",
)
oracle(
    "event_window",
    "y:flight_date d:event_pct,control_pct b:is_peak",
    f"""
SELECT *, row_number() OVER (ORDER BY event_pct DESC NULLS LAST, flight_date) = 1 AS is_peak
FROM ({EVENT.replace("FROM flights", f"FROM flights WHERE {THE_WEEK}")})
""",
)
DAMAGE_SLICE = f"""
SELECT root_dep_hour_local AS hour, count(*) AS roots, avg(downstream_legs) AS legs,
       avg(downstream_delay_minutes) AS minutes, {exact_avg('amplification_ratio', 2)} AS amplification
FROM cascades WHERE root_dep_hour_local BETWEEN 5 AND 22 AND {NARROW.format(airport='root_origin')} GROUP BY 1
"""
oracle("filtered_damage", HOURLY, DAMAGE_SLICE)
oracle(
    "filtered_damage_week",
    HOURLY,
    DAMAGE_SLICE.replace(" GROUP BY 1", f" AND {THE_WEEK} GROUP BY 1"),
)
oracle(
    "damage_vs_repair",
    f"{HOURLY} i:turns d:efficiency",
    f"""
SELECT * FROM ({DAMAGE_SLICE}) FULL JOIN (
  SELECT sched_dep_hour_local AS hour, count(*) AS turns,
         ({models.passed_on(0)} - {models.passed_on(10)}) / (count(*) * 10.0) AS efficiency
  FROM legs WHERE is_continuation AND sched_dep_hour_local BETWEEN 5 AND 22 AND {BY_ORIGIN} GROUP BY 1)
USING (hour)
""",
)
oracle(
    "worst_cascade_days",
    "s:tail_number y:flight_date i:legs,longest_cascade,inherited_minutes,worst_arrival",
    """
SELECT * FROM (
  SELECT *, row_number() OVER (ORDER BY inherited_minutes DESC, tail_number, flight_date) AS place
  FROM (SELECT tail_number, flight_date, count(*) AS legs, max(cascade_length) AS longest_cascade,
               sum(inherited_delay_minutes) AS inherited_minutes, max(arr_delay) AS worst_arrival
        FROM legs GROUP BY tail_number, flight_date)
  WHERE longest_cascade >= 1)
WHERE place <= 60
""",
)
oracle(
    "filter_description",
    "s:shown i:flights",
    f"""
SELECT 'all carriers' AS shown, count(*) AS flights FROM flights
UNION ALL SELECT 'AA, WN, OO · via ATL, DEN, ORD, HNL', count(*) FROM flights WHERE {BY_ORIGIN}
UNION ALL SELECT 'AA, WN, OO · via ATL, DEN, ORD, HNL · 2024-01-08 to 2024-01-14', count(*) FROM flights WHERE {IN_WEEK}
UNION ALL SELECT 'AA', count(*) FROM flights WHERE carrier = 'AA'
UNION ALL SELECT 'all carriers · 2024-01-08 to end', count(*) FROM flights WHERE flight_date >= DATE '2024-01-08'
""",
)
oracle(
    "models_by_name",
    "s:carrier i:flights,inherited,cascades,downstream",
    """
SELECT * FROM (SELECT carrier, count(*) AS flights, sum(inherited_delay_minutes) AS inherited FROM flights GROUP BY carrier)
JOIN (SELECT carrier, count(*) AS cascades, sum(downstream_delay_minutes) AS downstream FROM cascades GROUP BY carrier)
USING (carrier)
""",
)
DAY_LEGS = """
(SELECT *, row_number() OVER (PARTITION BY tail_number, flight_date ORDER BY leg_seq) AS leg_of_day,
        min(sched_dep_utc) OVER (PARTITION BY tail_number, flight_date) AS base
 FROM legs)
"""


def clock(minute: str) -> str:
    return f"lpad(({minute} // 60 % 24)::VARCHAR, 2, '0') || ':' || lpad(({minute} % 60)::VARCHAR, 2, '0')"


oracle(
    "rotation_timeline",
    "s:tail_number y:flight_date i:leg_seq s:origin,dest i:dep_delay,arr_delay,inherited_delay_minutes "
    "d:turn_slack_minutes i:sched_turn_minutes,cascade_position,cascade_length s:primary_cause "
    "b:is_continuation d:sched_offset,actual_offset,sched_minutes,actual_minutes s:sched_dep_hhmm,"
    "sched_arr_hhmm,actual_dep_hhmm,actual_arr_hhmm",
    f"""
SELECT * REPLACE (leg_of_day AS leg_seq), sched_dep_utc - base AS sched_offset,
       actual_dep_utc - base AS actual_offset, sched_arr_utc - sched_dep_utc AS sched_minutes,
       actual_arr_utc - actual_dep_utc AS actual_minutes,
       {clock('sched_dep_utc::BIGINT')} AS sched_dep_hhmm, {clock('sched_arr_utc::BIGINT')} AS sched_arr_hhmm,
       {clock('actual_dep_utc::BIGINT')} AS actual_dep_hhmm, {clock('actual_arr_utc::BIGINT')} AS actual_arr_hhmm
FROM {DAY_LEGS}
""",
)
oracle(
    "cascade_start",
    "s:tail_number y:flight_date i:day_inherited_minutes,start_leg s:origin,dest d:turn_slack_minutes "
    "i:sched_turn_minutes,inherited_delay_minutes",
    f"""
SELECT *, leg_of_day AS start_leg FROM (
  SELECT *, sum(inherited_delay_minutes) OVER day AS day_inherited_minutes,
         min(if(is_inheriting, leg_of_day, NULL)) OVER day AS earliest
  FROM {DAY_LEGS} WINDOW day AS (PARTITION BY tail_number, flight_date))
WHERE leg_of_day = earliest
""",
)
oracle(
    "rotation_breaks",
    "s:tail_number y:flight_date i:legs,broken_legs",
    """
SELECT tail_number, flight_date, count(*) AS legs, sum(1 - is_continuation::INT) AS broken_legs
FROM legs GROUP BY tail_number, flight_date
""",
)
oracle(
    "station_opportunities",
    "s:carrier,station,label,city i:turns d:sched_turn,min_turn,slack,tight_pct,minutes_saved,efficiency,"
    "cost_avoided_usd",
    f"""
SELECT carrier_name AS carrier, airport_code AS station,
       replace(carrier_name, ' Airlines', '') || ' · ' || airport_code AS label, city, turns,
       median_sched_turn_minutes AS sched_turn, min_feasible_turn_minutes AS min_turn,
       median_slack_minutes AS slack, tight_turn_pct AS tight_pct, minutes_saved_plus_10 AS minutes_saved,
       efficiency_plus_10 AS efficiency, delay_cost_avoided_usd_plus_10 AS cost_avoided_usd
FROM (SELECT *, row_number() OVER (ORDER BY minutes_saved_plus_10 DESC, carrier, airport_code) AS place
      FROM opportunities WHERE {NARROW.format(airport='airport_code')})
WHERE place <= 40
""",
)

oracle(
    "station_labels",
    "s:label d:slack,minutes_saved,cost_avoided_usd",
    f"""
SELECT carrier_name AS carrier, airport_code AS station,
       replace(carrier_name, ' Airlines', '') || ' · ' || airport_code AS label, city, turns,
       median_sched_turn_minutes AS sched_turn, min_feasible_turn_minutes AS min_turn,
       median_slack_minutes AS slack, tight_turn_pct AS tight_pct, minutes_saved_plus_10 AS minutes_saved,
       efficiency_plus_10 AS efficiency, delay_cost_avoided_usd_plus_10 AS cost_avoided_usd
FROM (SELECT *, row_number() OVER (ORDER BY minutes_saved_plus_10 DESC, carrier, airport_code) AS place
      FROM opportunities WHERE {NARROW.format(airport='airport_code')})
WHERE place <= 12
""",
)

# ----------------------------------------------------------------------- quality


def check(name: str, bound: str, observed: str, passed: str) -> str:
    """One row; ``observed`` is a scalar query, ``passed`` a predicate on o."""
    return (
        f"SELECT '{name}' AS check_name, '{bound}' AS bound, o AS observed, coalesce({passed}, FALSE) AS passed "
        f"FROM (SELECT round(CAST(({observed}) AS DOUBLE), 6) AS o)"
    )


def violations(name: str, relation: str, predicate: str) -> str:
    return check(name, "= 0", f"SELECT count(*) FROM {relation} WHERE {predicate}", "o = 0")


def filled(name: str, relation: str) -> str:
    return check(f"{name}_populated", "> 0", f"SELECT count(*) FROM {relation}", "o > 0")


ATTRIBUTED_SUM = "carrier_delay + weather_delay + nas_delay + security_delay + late_aircraft_delay"
PAIR_AVG = (
    "SELECT avg(inherited_delay_minutes) FROM legs"
    " WHERE is_continuation AND prev_arr_delay BETWEEN 30 AND 60 AND turn_slack_minutes"
)
CHECKS = [
    check("every_month_present", "= 2", "SELECT count(DISTINCT year * 100 + month) FROM flights", "o = 2"),
    check(
        "flights_per_year_plausible", "> 100 and < 9e+06",
        "SELECT count(*) / count(DISTINCT year) FROM flights", "o > 100 AND o < 9000000",
    ),
    violations(
        "causes_sum_to_arrival_delay", "flights",
        f"has_complete_attribution AND abs({ATTRIBUTED_SUM} - arr_delay_minutes) > 1",
    ),
    check(
        "unexplained_delays_negligible", "< 0.01",
        "SELECT count_if(NOT has_complete_attribution) / count(*) FROM flights WHERE has_cause_attribution",
        "o < 0.01",
    ),
    violations("causes_only_on_late_arrivals", "flights", "has_cause_attribution AND completed AND arr_delay < 15"),
    violations(
        "root_and_inherited_partition_delay", "flights",
        "has_complete_attribution AND abs(root_delay_minutes + inherited_delay_minutes - arr_delay_minutes) > 1",
    ),
    violations("arrival_follows_departure", "flights", "sched_arr_utc <= sched_dep_utc"),
    check(
        "invalid_schedules_flagged", "> 0 and < 1000",
        "SELECT count(*) FROM flights WHERE crs_elapsed_time <= 0", "o > 0 AND o < 1000",
    ),
    violations("invalid_schedules_have_no_arrival", "flights", "NOT is_schedule_valid AND sched_arr_utc IS NOT NULL"),
    violations(
        "departure_matches_reported_delay", "flights",
        "completed AND actual_dep_utc - sched_dep_utc <> dep_delay",
    ),
    check(
        "daylight_saving_offsets", "= 1",
        "SELECT count(DISTINCT (sched_dep_utc - sched_dep_local) // 60) FROM flights WHERE origin = 'ORD'", "o = 1",
    ),
    violations("cancelled_never_on_time", "flights", "(cancelled OR diverted) AND is_on_time_a14"),
    check(
        "on_time_rate_in_band", "> 50 and < 90", f"SELECT {pct('is_on_time_a14')} FROM flights",
        "o > 50 AND o < 90",
    ),
    violations(
        "no_duplicate_legs",
        "(SELECT count(*) AS n FROM flights GROUP BY flight_date, carrier, flight_number, origin, dest, crs_dep_time)",
        "n > 1",
    ),
    violations("every_airport_mapped", "airports", "NOT is_mapped OR timezone IS NULL"),
    violations("every_carrier_named", "carriers", "NOT is_mapped"),
    check("calendar_without_gaps", "= 31", "SELECT count(*) FROM dates", "o = 31"),
    violations(
        "continuations_physically_possible", "legs",
        "is_continuation AND (prev_dest <> origin OR sched_turn_minutes < 0)",
    ),
    violations("no_placeholder_tails", "legs", "tail_number IN ('UNKNOW', 'N/A', '-N/A-', '000000', '')"),
    check(
        "model_tracks_reported", "> 0.1",
        "SELECT corr(predicted_inherited_minutes, inherited_delay_minutes) FROM legs"
        " WHERE is_continuation AND prev_arr_delay > 15",
        "o > 0.1",
    ),
    check(
        "slack_reduces_inherited", "> 1.01",
        f"SELECT ({PAIR_AVG} < 15) / nullif(({PAIR_AVG} >= 60), 0)", "o > 1.01",
    ),
    violations(
        "one_root_per_cascade",
        "(SELECT count(*) AS n FROM legs WHERE cascade_position = 0 GROUP BY tail_number, cascade_id)", "n <> 1",
    ),
    filled("carrier_monthly", "monthly"),
    violations(
        "carrier_monthly_on_time_arrival_pct_is_percentage", "monthly",
        "on_time_arrival_pct < 0 OR on_time_arrival_pct > 100",
    ),
    violations(
        "carrier_monthly_completion_factor_pct_is_percentage", "monthly",
        "completion_factor_pct < 0 OR completion_factor_pct > 100",
    ),
    check(
        "carrier_monthly_reconciles", "= 0",
        "SELECT abs((SELECT sum(scheduled_flights) FROM monthly) - (SELECT count(*) FROM flights))", "o = 0",
    ),
    filled("airport_daily", "daily"),
    violations(
        "airport_daily_cancellation_rate_pct_is_percentage", "daily",
        "cancellation_rate_pct < 0 OR cancellation_rate_pct > 100",
    ),
    filled("route_reliability", "routes"),
    violations(
        "route_reliability_on_time_arrival_pct_is_percentage", "routes",
        "on_time_arrival_pct < 0 OR on_time_arrival_pct > 100",
    ),
    filled("cascade", "cascades"),
    filled("turn_slack_opportunity", "opportunities"),
]
oracle("dq_suite", "s:check_name d:observed s:bound b:passed", "\nUNION ALL\n".join(CHECKS))

PROFILED = {
    "stg_airport": (
        "airport_ref",
        "airport_code:string airport_name:string city:string country:string latitude:double longitude:double "
        "timezone:string",
    ),
    "stg_flight": (
        "flights",
        "origin_tz:string dest:string origin:string event_id:bigint flight_date:date crs_dep_time:int "
        "carrier:string tail_number:string flight_number:int crs_elapsed_time:int cancelled:boolean "
        "diverted:boolean cancellation_code:string arr_delay:int dep_delay:int taxi_out:int "
        "distance_miles:double quarter:int day_of_month:int day_of_week:int arr_delay_minutes:int "
        "dep_delay_minutes:int arr_del15:boolean dep_del15:boolean actual_elapsed_time:int carrier_delay:int "
        "weather_delay:int nas_delay:int security_delay:int late_aircraft_delay:int air_time:int year:int "
        "month:int dest_tz:string sched_dep_local:timestamp_ntz sched_dep_utc:timestamp "
        "is_schedule_valid:boolean sched_arr_utc:timestamp actual_dep_utc:timestamp actual_arr_utc:timestamp",
    ),
    "dim_airport": (
        "airports",
        "airport_code:string airport_name:string city:string country:string latitude:double longitude:double "
        "timezone:string departures:bigint arrivals:bigint departure_share:double size_band:string "
        "is_mapped:boolean",
    ),
    "dim_carrier": (
        "carriers",
        "carrier:string carrier_name:string carrier_type:string operates_for:string is_mapped:boolean "
        "flights:bigint first_seen:date last_seen:date",
    ),
    "dim_date": (
        "dates",
        "date_day:date year:int quarter:int month:int month_name:string day_of_month:int iso_day_of_week:int "
        "day_name:string is_weekend:boolean holiday_name:string is_federal_holiday:boolean "
        "travel_period:string",
    ),
    "fct_flight": (
        "flights",
        "flight_date:date carrier:string flight_number:int tail_number:string origin:string dest:string "
        "quarter:int day_of_week:int sched_dep_utc:timestamp sched_arr_utc:timestamp actual_dep_utc:timestamp "
        "actual_arr_utc:timestamp sched_dep_local:timestamp_ntz crs_dep_time:int cancelled:boolean "
        "cancellation_code:string diverted:boolean is_schedule_valid:boolean dep_delay:int "
        "dep_delay_minutes:int dep_del15:boolean arr_delay:int arr_delay_minutes:int arr_del15:boolean "
        "taxi_out:int crs_elapsed_time:int actual_elapsed_time:int air_time:int distance_miles:double "
        "carrier_delay:int weather_delay:int nas_delay:int security_delay:int late_aircraft_delay:int "
        "event_id:bigint route:string sched_dep_hour_local:int cancellation_reason:string completed:boolean "
        "is_on_time_a14:boolean block_time_variance:int primary_cause:string has_cause_attribution:boolean "
        "has_complete_attribution:boolean root_delay_minutes:int inherited_delay_minutes:int "
        "controllable_root_minutes:int external_root_minutes:int year:int month:int",
    ),
    "int_rotation_leg": (
        "legs",
        "tail_number:string flight_date:date carrier:string flight_number:int origin:string dest:string "
        "quarter:int day_of_week:int sched_dep_utc:timestamp sched_arr_utc:timestamp actual_dep_utc:timestamp "
        "actual_arr_utc:timestamp sched_dep_local:timestamp_ntz crs_dep_time:int dep_delay:int "
        "dep_delay_minutes:int dep_del15:boolean arr_delay:int arr_delay_minutes:int arr_del15:boolean "
        "taxi_out:int crs_elapsed_time:int actual_elapsed_time:int air_time:int distance_miles:double "
        "carrier_delay:int weather_delay:int nas_delay:int security_delay:int late_aircraft_delay:int "
        "event_id:bigint route:string sched_dep_hour_local:int is_on_time_a14:boolean block_time_variance:int "
        "primary_cause:string has_cause_attribution:boolean has_complete_attribution:boolean "
        "root_delay_minutes:int inherited_delay_minutes:int controllable_root_minutes:int "
        "external_root_minutes:int leg_seq:bigint prev_dest:string prev_carrier:string prev_flight_date:date "
        "prev_flight_number:int prev_origin:string prev_sched_arr_utc:timestamp prev_actual_arr_utc:timestamp "
        "prev_arr_delay:int prev_root_delay_minutes:int prev_inherited_delay_minutes:int "
        "prev_primary_cause:string sched_turn_minutes:bigint actual_turn_minutes:bigint "
        "is_continuation:boolean is_inheriting:boolean cascade_id:bigint cascade_position:bigint "
        "cascade_length:bigint year:int month:int",
    ),
    "ref_min_turn": (
        "floors",
        "carrier:string airport:string sample_size:bigint min_turn_minutes:double benchmark_level:string",
    ),
    "fct_rotation_leg": (
        "legs",
        "carrier:string origin:string tail_number:string flight_date:date flight_number:int dest:string "
        "quarter:int day_of_week:int sched_dep_utc:timestamp sched_arr_utc:timestamp actual_dep_utc:timestamp "
        "actual_arr_utc:timestamp sched_dep_local:timestamp_ntz crs_dep_time:int dep_delay:int "
        "dep_delay_minutes:int dep_del15:boolean arr_delay:int arr_delay_minutes:int arr_del15:boolean "
        "taxi_out:int crs_elapsed_time:int actual_elapsed_time:int air_time:int distance_miles:double "
        "carrier_delay:int weather_delay:int nas_delay:int security_delay:int late_aircraft_delay:int "
        "event_id:bigint route:string sched_dep_hour_local:int is_on_time_a14:boolean block_time_variance:int "
        "primary_cause:string has_cause_attribution:boolean has_complete_attribution:boolean "
        "root_delay_minutes:int inherited_delay_minutes:int controllable_root_minutes:int "
        "external_root_minutes:int leg_seq:bigint prev_dest:string prev_carrier:string prev_flight_date:date "
        "prev_flight_number:int prev_origin:string prev_sched_arr_utc:timestamp prev_actual_arr_utc:timestamp "
        "prev_arr_delay:int prev_root_delay_minutes:int prev_inherited_delay_minutes:int "
        "prev_primary_cause:string sched_turn_minutes:bigint actual_turn_minutes:bigint "
        "is_continuation:boolean is_inheriting:boolean cascade_id:bigint cascade_position:bigint "
        "cascade_length:bigint year:int month:int min_turn_minutes:double benchmark_level:string "
        "turn_slack_minutes:double predicted_inherited_minutes:double inherited_prediction_error:double "
        "cancelled:boolean diverted:boolean completed:boolean is_schedule_valid:boolean "
        "cancellation_code:string cancellation_reason:string",
    ),
    "ref_cost_assumption": (
        "(SELECT 1 AS assumption, 1 AS value, 1 AS note, 1 AS source FROM range(2))",
        "assumption:string value:decimal(5,2) note:string source:string",
    ),
    "mart_carrier_monthly": (
        "monthly",
        "carrier:string year:int month:int scheduled_flights:bigint completed_flights:bigint "
        "cancelled_flights:bigint diverted_flights:bigint on_time_arrival_pct:double "
        "completion_factor_pct:double cancellation_rate_pct:double avg_arr_delay_minutes:double "
        "p90_arr_delay_minutes:double median_arr_delay_minutes:double root_delay_minutes:bigint "
        "inherited_delay_minutes:bigint controllable_root_minutes:bigint external_root_minutes:bigint "
        "avg_block_variance_minutes:double month_start:date inherited_share_pct:double carrier_name:string "
        "carrier_type:string",
    ),
    "mart_airport_daily": (
        "daily",
        "flight_date:date airport_code:string departures:bigint carriers_operating:bigint "
        "cancellations:bigint cancellation_rate_pct:double departures_delayed_pct:double "
        "avg_dep_delay_minutes:double p90_dep_delay_minutes:double avg_taxi_out_minutes:double "
        "root_delay_minutes:bigint inherited_delay_minutes:bigint city:string size_band:string "
        "travel_period:string is_federal_holiday:boolean day_name:string",
    ),
    "mart_route_reliability": (
        "routes",
        "carrier:string dest:string origin:string route:string flights:bigint distance_miles:double "
        "avg_scheduled_block_minutes:double on_time_arrival_pct:double cancellation_rate_pct:double "
        "avg_arr_delay_minutes:double p90_arr_delay_minutes:double avg_block_variance_minutes:double "
        "avg_air_time_minutes:double root_delay_minutes:bigint inherited_delay_minutes:bigint "
        "origin_city:string origin_size_band:string dest_city:string carrier_name:string",
    ),
    "mart_cascade": (
        "cascades",
        "carrier:string tail_number:string cascade_id:bigint flight_date:date root_origin:string "
        "root_dest:string root_sched_dep_utc:timestamp root_dep_hour_local:int root_arr_delay:int "
        "root_delay_minutes:int root_controllable_minutes:int root_external_minutes:int "
        "root_primary_cause:string downstream_legs:bigint downstream_delay_minutes:bigint "
        "downstream_stations_touched:bigint total_cascade_minutes:bigint amplification_ratio:double "
        "total_cascade_cost_usd:decimal(38,2) carrier_name:string carrier_type:string",
    ),
    "mart_turn_slack_opportunity": (
        "opportunities",
        "carrier:string airport_code:string benchmark_level:string turns:bigint "
        "median_sched_turn_minutes:double min_feasible_turn_minutes:double median_slack_minutes:double "
        "tight_turn_pct:double actual_inherited_minutes:bigint minutes_saved_plus_5:double "
        "minutes_saved_plus_10:double minutes_saved_plus_15:double efficiency_plus_10:double "
        "delay_cost_avoided_usd_plus_10:double city:string size_band:string carrier_name:string",
    ),
}


def profile(table: str, relation: str, columns: str) -> str:
    specs = [c.split(":") for c in columns.split()]
    names = ", ".join(f"'{n}'" for n, _ in specs)
    types = ", ".join(f"'{t}'" for _, t in specs)
    counts = ", ".join(f"count({n})" for n, _ in specs)
    return (
        f"SELECT '{table}' AS table_name, unnest(range(1, {len(specs) + 1})) AS ordinal, "
        f"unnest([{names}]) AS column_name, unnest([{types}]) AS data_type, "
        f"unnest([{counts}]) AS filled_rows, count(*) AS table_rows FROM {relation}"
    )


oracle(
    "table_profile",
    "s:table_name i:ordinal s:column_name,data_type i:filled_rows,table_rows",
    "\nUNION ALL\n".join(profile(t, r, c) for t, (r, c) in PROFILED.items()),
)

oracle(
    "build_log",
    "s:model i:rows",
    "\nUNION ALL\n".join(f"SELECT '{t}' AS model, count(*) AS rows FROM {r}" for t, (r, _) in PROFILED.items()),
)
oracle(
    "json_file",
    "i:flights,place,length,cascades d:avg_minutes",
    f"""
SELECT (SELECT count(*) FROM flights) AS flights, row_number() OVER (ORDER BY length) - 1 AS place, length, cascades,
       avg_minutes
FROM ({LENGTHS})
""",
)

# ------------------------------------------- the generic operators on other tables

oracle(
    "scorecard_lineitem",
    "s:l_linestatus i:l_linenumber,lines,suppliers d:returned_pct,avg_quantity,p90_quantity y:last_ship",
    f"""
SELECT l_linestatus, l_linenumber, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers,
       {pct("l_returnflag = 'R'", 2)} AS returned_pct,
       round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2) AS avg_quantity,
       round(quantile_cont(l_quantity, 0.9) FILTER (WHERE l_returnflag = 'R'), 1) AS p90_quantity,
       max(l_shipdate) AS last_ship
FROM lineitem GROUP BY l_linestatus, l_linenumber
""",
)
oracle(
    "benchmark_floor_lineitem",
    "i:supplier,line,sample_size d:floor_value s:benchmark_level",
    """
WITH q AS (SELECT l_suppkey AS supplier, l_linenumber AS line, CAST(l_quantity AS INT) AS x FROM lineitem),
     wide AS (SELECT supplier, count(*) AS n, quantile_cont(x, 0.05) AS f FROM q GROUP BY supplier)
SELECT q.supplier, line, count(*) AS sample_size,
       CASE WHEN count(*) >= 90 THEN quantile_cont(x, 0.05) WHEN any_value(w.n) >= 90 THEN any_value(w.f)
            ELSE (SELECT quantile_cont(x, 0.05) FROM q) END AS floor_value,
       CASE WHEN count(*) >= 90 THEN 'supplier_line' WHEN any_value(w.n) >= 90 THEN 'supplier'
            ELSE 'all' END AS benchmark_level
FROM q LEFT JOIN wide w USING (supplier) GROUP BY q.supplier, line
""",
)
oracle(
    "exact_quantiles_lineitem",
    "s:l_returnflag,l_linestatus i:known d:p05,p50,p95",
    """
SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS known, quantile_cont(l_extendedprice, 0.05) AS p05,
       quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95
FROM lineitem GROUP BY l_returnflag, l_linestatus
""",
)
oracle(
    "window_join_events",
    "i:window_seconds,pairs,windows,id_sum",
    """
SELECT window_seconds, count(*) AS pairs, count(DISTINCT opened_by) AS windows, sum(e.event_id) AS id_sum
FROM (SELECT user_id, event_id AS opened_by, ts AS opens,
             [600, 10800, 172800, 1728000, 94608000][(event_id // 10) % 5 + 1] AS window_seconds
      FROM events WHERE event_id % 10 = 0) w
JOIN events e ON e.user_id = w.user_id AND e.ts >= w.opens AND e.ts < w.opens + to_seconds(w.window_seconds)
GROUP BY window_seconds
""",
)
