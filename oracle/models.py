"""The models over the leg feed in SQL; instants are minutes since 1970."""

from __future__ import annotations

from oracle.chain import step

RATE = "98.41::DECIMAL(5,2)"

step("stations", """
SELECT * FROM (VALUES
  (0, 'ATL', 'America/New_York'), (1, 'DEN', 'America/Denver'), (2, 'DFW', 'America/Chicago'),
  (3, 'LAX', 'America/Los_Angeles'), (4, 'ORD', 'America/Chicago'), (5, 'PHX', 'America/Phoenix'),
  (6, 'HNL', 'Pacific/Honolulu'), (7, 'SEA', 'America/Los_Angeles')) AS t(slot, code, zone)
""")

step("placed", """
SELECT e.event_id AS i, e.user_id AS u, CAST(floor(e.value) AS BIGINT) AS v, s.code AS origin,
       s.zone, (e.ts AT TIME ZONE 'UTC') AT TIME ZONE s.zone AS lt,
       lead(s.code) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS following
FROM events e JOIN stations s ON s.slot = (3 * e.event_id + e.user_id) % 7
""")

step("timed", """
SELECT i AS event_id, origin, zone AS origin_tz, CAST(lt AS DATE) AS flight_date,
       hour(lt) * 100 + minute(lt) AS crs_dep_time,
       CASE WHEN i % 11 = 0 THEN 'SEA' ELSE coalesce(following, 'SEA') END AS dest,
       ['AA', 'DL', 'WN', 'UA', 'OO'][1 + u % 5] AS carrier,
       CASE WHEN u % 50 = 49 THEN 'UNKNOW' ELSE 'N' || (100 + u) END AS tail_number,
       i % 9000 AS flight_number,
       CASE WHEN i % 997 = 0 THEN -30 ELSE 45 + i % 120 END AS crs_elapsed_time,
       i % 53 = 0 AS cancelled, i % 53 <> 0 AND i % 211 = 0 AS diverted,
       CASE WHEN i % 53 = 0 THEN ['A', 'B', 'C', 'D'][1 + (i // 53) % 4] END AS cancellation_code,
       CASE WHEN i % 53 <> 0 AND i % 211 <> 0 THEN v - 25 END AS arr_delay,
       CASE WHEN i % 53 <> 0 THEN v - 20 + i % 10 END AS dep_delay,
       CASE WHEN i % 53 <> 0 THEN 8 + i % 20 END AS taxi_out,
       200.0::DOUBLE + (i % 40) * 50 AS distance_miles
FROM placed
""")

step("caused", """
SELECT event_id, arr_delay AS d,
       CASE WHEN event_id % 2 = 0 THEN arr_delay * 6 // 10 ELSE 0 END AS late_part,
       CASE WHEN event_id % 7 = 0 THEN arr_delay // 10 ELSE 0 END AS weather_part,
       CASE WHEN event_id % 3 = 0 THEN arr_delay * 2 // 10 ELSE 0 END AS nas_part,
       CASE WHEN event_id % 101 = 0 THEN arr_delay // 20 ELSE 0 END AS security_part,
       CASE WHEN event_id % 1999 = 0 THEN 0 ELSE 1 END AS told
FROM timed WHERE arr_delay >= 15
""")

step("feed", """
SELECT t.*, told * (d - late_part - weather_part - nas_part - security_part) AS carrier_delay,
       told * weather_part AS weather_delay, told * nas_part AS nas_delay,
       told * security_part AS security_delay, told * late_part AS late_aircraft_delay,
       year(flight_date) AS year, quarter(flight_date) AS quarter, month(flight_date) AS month,
       day(flight_date) AS day_of_month, isodow(flight_date) AS day_of_week,
       CASE WHEN arr_delay < 0 THEN 0 ELSE arr_delay END AS arr_delay_minutes,
       CASE WHEN dep_delay < 0 THEN 0 ELSE dep_delay END AS dep_delay_minutes,
       arr_delay >= 15 AS arr_del15, dep_delay >= 15 AS dep_del15,
       crs_elapsed_time + arr_delay - dep_delay AS actual_elapsed_time,
       crs_elapsed_time + arr_delay - dep_delay - taxi_out - 5 AS air_time
FROM timed t LEFT JOIN caused USING (event_id)
""")

step("instants", """
SELECT f.*, s.zone AS dest_tz,
       epoch(flight_date + to_minutes(crs_dep_time // 100 * 60 + crs_dep_time % 100)) // 60 AS sched_dep_local,
       epoch((flight_date + to_minutes(crs_dep_time // 100 * 60 + crs_dep_time % 100))
             AT TIME ZONE origin_tz) // 60 AS dep_m
FROM feed f JOIN stations s ON s.code = f.dest
""")

step("flights", """
SELECT x.*, origin || '-' || dest AS route, crs_dep_time // 100 AS sched_dep_hour_local,
       NOT (cancelled OR diverted) AS completed, crs_elapsed_time > 0 AS is_schedule_valid,
       dep_m AS sched_dep_utc,
       if(crs_elapsed_time > 0, dep_m + crs_elapsed_time, NULL) AS sched_arr_utc,
       dep_m + dep_delay AS actual_dep_utc,
       if(crs_elapsed_time > 0, dep_m + crs_elapsed_time + arr_delay, NULL) AS actual_arr_utc,
       if(cancelled OR diverted, FALSE, arr_delay < 15) AS is_on_time_a14,
       actual_elapsed_time - crs_elapsed_time AS block_time_variance,
       ['Carrier', 'Weather', 'National Air System', 'Security'][ascii(cancellation_code) - 64]
         AS cancellation_reason,
       coalesce(carrier_delay, 0) AS controllable_root_minutes,
       coalesce(weather_delay + nas_delay + security_delay, 0) AS external_root_minutes,
       coalesce(carrier_delay + weather_delay + nas_delay + security_delay, 0) AS root_delay_minutes,
       coalesce(late_aircraft_delay, 0) AS inherited_delay_minutes,
       late_aircraft_delay IS NOT NULL AS has_cause_attribution,
       coalesce(carrier_delay + weather_delay + nas_delay + security_delay + late_aircraft_delay, 0) > 0
         AS has_complete_attribution,
       (SELECT label FROM (VALUES
           (carrier_delay, 1, 'Carrier'), (late_aircraft_delay, 2, 'Late aircraft'),
           (nas_delay, 3, 'National Air System'), (weather_delay, 4, 'Weather'),
           (security_delay, 5, 'Security'), (0, 0, 'None reported')) AS c(amount, place, label)
        WHERE late_aircraft_delay IS NOT NULL
        ORDER BY amount DESC, place LIMIT 1) AS primary_cause
FROM instants x
""")

step("sequenced", """
SELECT *, row_number() OVER aircraft AS leg_seq,
       lag(dest) OVER aircraft AS prev_dest, lag(carrier) OVER aircraft AS prev_carrier,
       lag(flight_date) OVER aircraft AS prev_flight_date,
       lag(flight_number) OVER aircraft AS prev_flight_number,
       lag(origin) OVER aircraft AS prev_origin,
       lag(sched_arr_utc) OVER aircraft AS prev_sched_arr_utc,
       lag(actual_arr_utc) OVER aircraft AS prev_actual_arr_utc,
       lag(arr_delay) OVER aircraft AS prev_arr_delay,
       lag(root_delay_minutes) OVER aircraft AS prev_root_delay_minutes,
       lag(inherited_delay_minutes) OVER aircraft AS prev_inherited_delay_minutes,
       lag(primary_cause) OVER aircraft AS prev_primary_cause
FROM flights
WHERE completed AND regexp_full_match(tail_number, 'N[0-9][0-9A-Z]{1,4}')
  AND actual_dep_utc IS NOT NULL AND actual_arr_utc IS NOT NULL
WINDOW aircraft AS (PARTITION BY tail_number ORDER BY sched_dep_utc, carrier, flight_number,
                    origin, dest, crs_dep_time, event_id)
""")

step("links", """
SELECT *, sched_dep_utc - prev_sched_arr_utc AS sched_turn_minutes,
       actual_dep_utc - prev_actual_arr_utc AS actual_turn_minutes,
       coalesce(prev_dest = origin AND sched_dep_utc - prev_sched_arr_utc >= 0
                AND sched_dep_utc - prev_sched_arr_utc <= 720, FALSE) AS is_continuation
FROM sequenced
""")

step("turns", """
SELECT carrier, origin AS airport, actual_turn_minutes AS m FROM links
WHERE is_continuation AND actual_turn_minutes BETWEEN 1 AND 720
""")


def floors_sql(min_sample: int) -> str:
    return f"""
SELECT a.carrier, a.airport, a.n AS sample_size,
       round(if(a.n >= {min_sample}, a.q, if(b.n >= {min_sample}, b.q, t.q)), 9) AS min_turn_minutes,
       if(a.n >= {min_sample}, 'carrier_airport', if(b.n >= {min_sample}, 'carrier', 'network')) AS benchmark_level
FROM (SELECT carrier, airport, count(*) AS n, quantile_cont(m, 0.05) AS q FROM turns GROUP BY ALL) a
LEFT JOIN (SELECT carrier, count(*) AS n, quantile_cont(m, 0.05) AS q FROM turns GROUP BY ALL) b
  ON a.carrier = b.carrier,
(SELECT quantile_cont(m, 0.05) AS q FROM turns) t
"""


step("floors", floors_sql(120))

step("sloped", """
SELECT l.*, f.min_turn_minutes, f.benchmark_level,
       coalesce(if(l.sched_turn_minutes > f.min_turn_minutes,
                   l.sched_turn_minutes - f.min_turn_minutes, 0), 0)::DOUBLE AS turn_slack_minutes,
       coalesce(l.prev_arr_delay, 0) AS inbound,
       l.is_continuation AND l.inherited_delay_minutes > 0 AS is_inheriting
FROM links l LEFT JOIN floors f ON f.carrier = l.carrier AND f.airport = l.origin
""")

step("numbered", """
SELECT *, if(is_continuation AND inbound > turn_slack_minutes AND inbound > 0,
             inbound - turn_slack_minutes, 0)::DOUBLE AS predicted_inherited_minutes,
       count(*) FILTER (WHERE NOT is_inheriting) OVER (PARTITION BY tail_number ORDER BY leg_seq) AS cascade_id
FROM sloped
""")

step("legs", """
SELECT *, inherited_delay_minutes - predicted_inherited_minutes AS inherited_prediction_error,
       leg_seq - min(leg_seq) OVER chain AS cascade_position,
       max(leg_seq) OVER chain - min(leg_seq) OVER chain AS cascade_length
FROM numbered WINDOW chain AS (PARTITION BY tail_number, cascade_id)
""")

step("carriers", """
SELECT carrier, carrier_name, carrier_type, operates_for, TRUE AS is_mapped, count(*) AS flights,
       min(flight_date) AS first_seen, max(flight_date) AS last_seen
FROM feed LEFT JOIN (VALUES
  ('AA', 'American Airlines', 'Network', NULL), ('DL', 'Delta Air Lines', 'Network', NULL),
  ('UA', 'United Airlines', 'Network', NULL), ('WN', 'Southwest Airlines', 'Low-cost', NULL),
  ('OO', 'SkyWest Airlines', 'Regional', 'AA / DL / UA / AS'))
  AS k(carrier, carrier_name, carrier_type, operates_for) USING (carrier)
GROUP BY ALL
""")

step("airport_file", """
SELECT code AS airport_code, code || ' Airport' AS airport_name, 'City of ' || code AS city,
       'United States' AS country, ascii(code) / 2.0 AS latitude, ascii(code) * -1.5 AS longitude,
       zone AS timezone
FROM stations
UNION ALL
SELECT code, min(c_name), min(c_mktsegment), 'NATION_' || min(c_nationkey), min(k % 180) - 90.0, max(k % 360) - 180.0,
       max(if(k % 5 = 0, NULL, 'America/Denver'))
FROM (SELECT *, c_custkey AS k,
             chr((65 + c_custkey // 676 % 26)::INT) || chr((65 + c_custkey // 26 % 26)::INT)
               || chr((65 + c_custkey % 26)::INT) AS code FROM customer)
WHERE code NOT IN (SELECT code FROM stations)
GROUP BY code
""")

step("corrected", """
SELECT * FROM (VALUES
  ('XWA', 'Williston Basin International Airport', 'Williston', 48.2581, -103.7486, 'America/Chicago'),
  ('BIH', 'Eastern Sierra Regional Airport', 'Bishop', 37.3731, -118.3636, 'America/Los_Angeles'),
  ('EAR', 'Kearney Regional Airport', 'Kearney', 40.7270, -99.0068, 'America/Chicago'),
  ('IFP', 'Laughlin/Bullhead International Airport', 'Bullhead City', 35.1574, -114.5595, 'America/Phoenix'))
  AS t(airport_code, airport_name, city, latitude, longitude, timezone)
""")

step("airport_ref", """
SELECT airport_code, coalesce(n.airport_name, o.airport_name) AS airport_name,
       coalesce(n.city, o.city) AS city, 
       if(n.airport_code IS NULL, o.country, 'United States') AS country,
       coalesce(n.latitude, o.latitude) AS latitude, coalesce(n.longitude, o.longitude) AS longitude,
       if(n.airport_code IS NULL, o.timezone, n.timezone) AS timezone
FROM airport_file o FULL JOIN corrected n USING (airport_code)
""")

step("activity", """
SELECT airport_code, sum(dep)::BIGINT AS departures, sum(arr)::BIGINT AS arrivals
FROM (SELECT origin AS airport_code, 1 AS dep, 0 AS arr FROM feed
      UNION ALL SELECT dest, 0, 1 FROM feed)
GROUP BY airport_code
""")

step("airports", """
SELECT a.*, r.* EXCLUDE (airport_code), departures / (SELECT count(*) FROM feed) AS departure_share,
       CASE WHEN departures * 100 >= total THEN 'Large' WHEN departures * 400 >= total THEN 'Medium'
            WHEN departures * 2000 >= total THEN 'Small' ELSE 'Non-hub' END AS size_band,
       r.airport_code IS NOT NULL AS is_mapped
FROM activity a LEFT JOIN airport_ref r USING (airport_code), (SELECT count(*) AS total FROM feed)
""")


def calendar_sql(span: str) -> str:
    """Calendar attributes of the days lo..hi of a one-row relation."""
    return f"""
SELECT d AS date_day, year(d) AS year, quarter(d) AS quarter, month(d) AS month,
       monthname(d) AS month_name, day(d) AS day_of_month, isodow(d) AS iso_day_of_week,
       dayname(d) AS day_name, isodow(d) IN (6, 7) AS is_weekend, holiday_name,
       holiday_name IS NOT NULL AS is_federal_holiday,
       CASE WHEN d >= thanks - 2 AND d <= thanks + 4 THEN 'Thanksgiving'
            WHEN strftime(d, '%m%d') >= '1220' OR strftime(d, '%m%d') <= '0103' THEN 'Christmas / New Year'
            WHEN dayofyear(d) BETWEEN 151 AND 249 THEN 'Summer peak' END AS travel_period
FROM (
  SELECT d, thanks, CASE strftime(d, '%m%d')
      WHEN '0101' THEN 'New Year''s Day' WHEN '0619' THEN 'Juneteenth'
      WHEN '0704' THEN 'Independence Day' WHEN '1111' THEN 'Veterans Day'
      WHEN '1225' THEN 'Christmas Day'
      ELSE CASE
        WHEN d = thanks THEN 'Thanksgiving'
        WHEN isodow(d) = 1 AND month(d) = 1 AND (day(d) + 6) // 7 = 3 THEN 'Martin Luther King Jr. Day'
        WHEN isodow(d) = 1 AND month(d) = 2 AND (day(d) + 6) // 7 = 3 THEN 'Presidents'' Day'
        WHEN isodow(d) = 1 AND month(d) = 5 AND day(d) > 24 THEN 'Memorial Day'
        WHEN isodow(d) = 1 AND month(d) = 9 AND day(d) <= 7 THEN 'Labor Day'
        WHEN isodow(d) = 1 AND month(d) = 10 AND (day(d) + 6) // 7 = 2 THEN 'Columbus Day' END
      END AS holiday_name
  FROM (SELECT d, {thanks_sql('year(d)')} AS thanks
        FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM ({span})))
)
"""


def thanks_sql(year: str) -> str:
    """Fourth Thursday of November."""
    return f"(make_date({year}, 11, 22) + CAST((11 - isodow(make_date({year}, 11, 22))) % 7 AS INT))"


step("dates", calendar_sql("SELECT min(flight_date)::TIMESTAMP AS lo, max(flight_date)::TIMESTAMP AS hi FROM feed"))


def pct(flag: str, digits: int | None = None) -> str:
    share = f"100.0 * avg(CAST({flag} AS INT))"
    return share if digits is None else f"round({share}, {digits})"


def done_avg(column: str, digits: int) -> str:
    return f"round(avg(if(completed, {column}, NULL)), {digits})"


def done_quantile(column: str, p: float, digits: int) -> str:
    return f"round(quantile_cont(if(completed, {column}, NULL), {p}), {digits})"


SPLIT_SUMS = "sum(root_delay_minutes) AS root_delay_minutes, sum(inherited_delay_minutes) AS inherited_delay_minutes"
INHERITED_PCT = (
    "100.0 * sum(inherited_delay_minutes)"
    " / nullif(sum(root_delay_minutes) + sum(inherited_delay_minutes), 0)"
)

def exact_avg(column: str, places: int) -> str:
    """Average summed in whole units of the last place."""
    return f"(sum(CAST(round({column} * 1e{places}) AS BIGINT)) / 1e{places} / count({column}))"


step("monthly", f"""
SELECT m.*, carrier_name, carrier_type FROM (
  SELECT year, month, date_trunc('month', min(flight_date)) AS month_start, carrier,
         count(*) AS scheduled_flights, count_if(completed) AS completed_flights,
         count_if(cancelled) AS cancelled_flights, count_if(diverted) AS diverted_flights,
         {pct('is_on_time_a14', 2)} AS on_time_arrival_pct, {pct('completed', 2)} AS completion_factor_pct,
         {pct('cancelled', 2)} AS cancellation_rate_pct,
         {done_avg('arr_delay', 2)} AS avg_arr_delay_minutes,
         {done_quantile('arr_delay', 0.5, 1)} AS median_arr_delay_minutes,
         {done_quantile('arr_delay', 0.9, 1)} AS p90_arr_delay_minutes, {SPLIT_SUMS},
         sum(controllable_root_minutes) AS controllable_root_minutes,
         sum(external_root_minutes) AS external_root_minutes,
         round({INHERITED_PCT}, 1) AS inherited_share_pct,
         {done_avg('block_time_variance', 2)} AS avg_block_variance_minutes
  FROM flights GROUP BY year, month, carrier) m JOIN carriers USING (carrier)
""")

step("daily", f"""
SELECT g.*, a.city, a.size_band, d.travel_period, d.is_federal_holiday, d.day_name FROM (
  SELECT flight_date, origin AS airport_code, count(*) AS departures,
         count(DISTINCT carrier) AS carriers_operating, count_if(cancelled) AS cancellations,
         {pct('cancelled', 2)} AS cancellation_rate_pct,
         {pct('(NOT cancelled AND dep_delay >= 15)', 2)} AS departures_delayed_pct,
         {done_avg('dep_delay', 2)} AS avg_dep_delay_minutes,
         {done_quantile('dep_delay', 0.9, 1)} AS p90_dep_delay_minutes,
         {done_avg('taxi_out', 2)} AS avg_taxi_out_minutes, {SPLIT_SUMS}
  FROM flights GROUP BY flight_date, origin) g
JOIN airports a USING (airport_code) JOIN dates d ON d.date_day = g.flight_date
""")

step("routes", f"""
SELECT g.*, o.city AS origin_city, p.city AS dest_city, o.size_band AS origin_size_band, k.carrier_name FROM (
  SELECT route, origin, dest, carrier, count(*) AS flights,
         round(avg(distance_miles), 0) AS distance_miles,
         round(avg(crs_elapsed_time), 1) AS avg_scheduled_block_minutes,
         {pct('is_on_time_a14', 2)} AS on_time_arrival_pct, {pct('cancelled', 2)} AS cancellation_rate_pct,
         {done_avg('arr_delay', 2)} AS avg_arr_delay_minutes,
         {done_quantile('arr_delay', 0.9, 1)} AS p90_arr_delay_minutes,
         {done_avg('block_time_variance', 2)} AS avg_block_variance_minutes,
         {done_avg('air_time', 1)} AS avg_air_time_minutes, {SPLIT_SUMS}
  FROM flights GROUP BY route, origin, dest, carrier) g
JOIN airports o ON o.airport_code = g.origin JOIN airports p ON p.airport_code = g.dest
JOIN carriers k USING (carrier)
WHERE g.flights >= 20
""")

step("cascades", f"""
SELECT g.*, k.carrier_name, k.carrier_type,
       root_delay_minutes + downstream_delay_minutes AS total_cascade_minutes,
       round((root_delay_minutes + downstream_delay_minutes) / root_delay_minutes, 2) AS amplification_ratio,
       (root_delay_minutes + downstream_delay_minutes)::BIGINT * {RATE} AS total_cascade_cost_usd
FROM (
  SELECT tail_number, cascade_id, arg_min(carrier, leg_seq) AS carrier,
         arg_min(flight_date, leg_seq) AS flight_date, arg_min(origin, leg_seq) AS root_origin,
         arg_min(dest, leg_seq) AS root_dest, arg_min(sched_dep_utc, leg_seq) AS root_sched_dep_utc,
         arg_min(sched_dep_hour_local, leg_seq) AS root_dep_hour_local,
         arg_min(arr_delay, leg_seq) AS root_arr_delay,
         arg_min(root_delay_minutes, leg_seq) AS root_delay_minutes,
         arg_min(controllable_root_minutes, leg_seq) AS root_controllable_minutes,
         arg_min(external_root_minutes, leg_seq) AS root_external_minutes,
         first(primary_cause ORDER BY leg_seq) AS root_primary_cause,
         count(*) - 1 AS downstream_legs,
         coalesce(sum(inherited_delay_minutes) FILTER (WHERE cascade_position > 0), 0)::BIGINT
           AS downstream_delay_minutes,
         count(DISTINCT dest) FILTER (WHERE cascade_position > 0) AS downstream_stations_touched
  FROM legs GROUP BY tail_number, cascade_id) g JOIN carriers k USING (carrier)
WHERE root_delay_minutes > 0
""")


def passed_on(added: int) -> str:
    need = f"inbound - turn_slack_minutes - {added}"
    return f"(sum(CAST(round(if({need} > 0, {need}, 0) * 1e6) AS BIGINT)) / 1e6)"


step("opportunities", f"""
SELECT g.* EXCLUDE (base, w5, w10, w15), base - w5 AS minutes_saved_plus_5, base - w10 AS minutes_saved_plus_10,
       base - w15 AS minutes_saved_plus_15, round((base - w10) / (turns * 10.0), 3) AS efficiency_plus_10,
       round((base - w10) * 98.41, 0) AS delay_cost_avoided_usd_plus_10, a.city, a.size_band, k.carrier_name
FROM (
  SELECT carrier, origin AS airport_code, count(*) AS turns,
         round(median(sched_turn_minutes), 0) AS median_sched_turn_minutes,
         round(median(min_turn_minutes), 0) AS min_feasible_turn_minutes,
         round(round(median(turn_slack_minutes), 9), 0) AS median_slack_minutes,
         {pct('turn_slack_minutes < 15', 1)} AS tight_turn_pct,
         sum(inherited_delay_minutes) AS actual_inherited_minutes, max(benchmark_level) AS benchmark_level,
         {passed_on(0)} AS base, {passed_on(5)} AS w5, {passed_on(10)} AS w10, {passed_on(15)} AS w15
  FROM legs WHERE is_continuation GROUP BY carrier, origin) g
JOIN airports a USING (airport_code) JOIN carriers k USING (carrier)
WHERE turns >= 50
""")

step("damage", f"""
SELECT root_dep_hour_local AS hour, count(*) AS roots, avg(downstream_legs) AS legs,
       avg(downstream_delay_minutes) AS minutes, {exact_avg('amplification_ratio', 2)} AS amplification
FROM cascades WHERE root_dep_hour_local BETWEEN 5 AND 22 GROUP BY 1
""")

step("repair", f"""
SELECT sched_dep_hour_local AS hour, count(*) AS turns,
       ({passed_on(0)} - {passed_on(10)}) / (count(*) * 10.0) AS efficiency
FROM legs WHERE is_continuation AND sched_dep_hour_local BETWEEN 5 AND 22 GROUP BY 1
""")
