"""Queries over readings: time checks, profiles, energy, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from helioquant.functions.numeric import round_half_up
from helioquant.functions.timestamps import DAY_FIRST, ISO_SECONDS, slot
from helioquant.operators import counters, energy, profile
from helioquant.plans.adapters import (
    BULK_SQL,
    GENERATION_SQL,
    PLANTS,
    WEATHER_SQL,
    arrival_number,
    bulk,
    day_text,
    flag,
    generation,
    table,
    ts_text,
    weather,
)
from helioquant.plans import sqltext as q
from helioquant.sources import feeds

# Values of these feeds carry two decimals (four where multiplied), so sums are fixed-point.
DECIMALS = 2
BULK_DECIMALS = 4
PER_DAY = 3
# The events cover 30 days, of 96 intervals each.
EXPECTED_SLOTS = 30 * 96

# Factors by which a plant's rated capacity is taken, by name of the scenario.
SCENARIOS = (("corrected", 1.0), ("uncorrected", 10.0))


def _time_text_frames(spark, sf):
    """Three feeds that write their clock as text; the third is not all in its stated form."""
    iso, day_first = "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm"
    orders = table(spark, sf, "orders")
    mixed = F.when(
        F.col("o_orderstatus") == "P", F.date_format("o_orderdate", iso)
    ).otherwise(F.date_format("o_orderdate", day_first))
    return {
        "events": table(spark, sf, "events").select(F.date_format("ts", iso).alias("ts_text")),
        "lineitem": table(spark, sf, "lineitem").select(
            F.date_format("l_shipdate", day_first).alias("ts_text")
        ),
        "orders": orders.select(mixed.alias("ts_text")),
    }


TIME_TEXT_SQL = f"""
texts AS (
  SELECT 'events' AS feed, strftime(ts, '{ISO_SECONDS}') AS ts_text FROM events
  UNION ALL SELECT 'lineitem', strftime(l_shipdate, '{DAY_FIRST}') FROM lineitem
  UNION ALL SELECT 'orders', CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '{ISO_SECONDS}')
                                  ELSE strftime(o_orderdate, '{DAY_FIRST}') END FROM orders)"""
FORMATS = {
    "events": (ISO_SECONDS, "ISO"),
    "lineitem": (DAY_FIRST, "day first"),
    "orders": (DAY_FIRST, "day first"),
}


def raw_time_samples(spark, sf):
    return feeds.raw_samples(_time_text_frames(spark, sf), n=3)


def timestamp_verification(spark, sf):
    report = feeds.verify_timestamps(_time_text_frames(spark, sf), FORMATS)
    return report.withColumns({c: ts_text(c) for c in ("earliest", "latest")})


def scope(spark, sf):
    df = profile.scope_profile(generation(spark, sf), by="plant")
    return df.withColumns({c: ts_text(c) for c in ("min_ts", "max_ts")})


def coverage_by_rows(spark, sf):
    return profile.device_coverage(
        generation(spark, sf), EXPECTED_SLOTS, keys=("plant", "device")
    )


def coverage_by_slots(spark, sf):
    return profile.device_coverage(
        generation(spark, sf), EXPECTED_SLOTS, keys=("plant",), distinct_slots=True
    )


def lowest_coverage(spark, sf):
    return profile.device_coverage(generation(spark, sf), EXPECTED_SLOTS, top_n=5)


def daily_intervals(spark, sf):
    return profile.daily_interval_distribution(generation(spark, sf), per_day=PER_DAY)


def missing_observed(spark, sf):
    return profile.missing_days(generation(spark, sf))


def missing_full(spark, sf):
    return profile.missing_days(bulk(spark, sf), calendar="full")


def _efficiencies(spark, sf):
    first = profile.efficiency_variants(
        generation(spark, sf), 10, 1, {"first raw": 1.0, "first dc x 0.1": 0.1}
    )
    second = profile.efficiency(bulk(spark, sf), 100, 10)
    return first.unionByName(profile.labelled({"second": second}).select("label", "eff"))


EFFICIENCY_SQL = """
effs AS (
  SELECT 'first raw' AS label, ac / dc AS eff FROM generation WHERE dc > 10 AND ac > 1
  UNION ALL
  SELECT 'first dc x 0.1', ac / (dc * CAST(0.1 AS DOUBLE)) FROM generation WHERE dc > 10 AND ac > 1
  UNION ALL
  SELECT 'second', ac / dc FROM bulk WHERE dc > 100 AND ac > 10)"""


def efficiency_quantiles(spark, sf):
    return profile.efficiency_profile(_efficiencies(spark, sf))


def scaling_check(spark, sf):
    return profile.scaling_artifact(_efficiencies(spark, sf), by="label")


def irradiance_range(spark, sf):
    return profile.irradiance_profile(weather(spark, sf))


def device_ratings(spark, sf):
    ratings = profile.device_ratings(bulk(spark, sf))
    names = ("p99_dc", "p99_ac", "max_dc", "max_ac")
    return ratings.withColumns({n: round_half_up(n, 6) for n in names})


def plant_capacity(spark, sf):
    return profile.rated_capacity(profile.device_ratings(bulk(spark, sf)), decimals=6)


def daily_specific_yield(spark, sf):
    """Yields per kWp of the capacity that the plants' own devices show, and of ten times that."""
    rated = plant_capacity(spark, sf).select("plant", "capacity_kwp")
    factors = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("factor")) for n, f in SCENARIOS])
    scenarios = rated.select("plant", "capacity_kwp", F.explode(factors).alias("s")).select(
        "plant", "s.scenario", (F.col("capacity_kwp") * F.col("s.factor")).alias("capacity_kwp")
    )
    return profile.specific_yield(bulk(spark, sf), scenarios, decimals=BULK_DECIMALS)


def device_day_energy(spark, sf):
    df = energy.integrated_energy(bulk(spark, sf), decimals=BULK_DECIMALS)
    return df.withColumn("log_date", day_text("log_date"))


def _reconciled(spark, sf):
    return energy.reconcile_energy(generation(spark, sf), decimals=DECIMALS)


def energy_reconciliation(spark, sf):
    df = _reconciled(spark, sf).withColumn("log_date", day_text("log_date"))
    names = ("total_span", "ratio_daily_to_integrated", "span_vs_daily_diff")
    return df.withColumns({n: round_half_up(n, 6) for n in names})


def reconciliation_summary(spark, sf):
    return energy.reconciliation_summary(_reconciled(spark, sf), decimals=6)


RECONCILED_SQL = f"""
reconciled AS (
  SELECT plant, device, CAST(ts AS DATE) AS d, {q.total('ac')} * CAST(0.25 AS DOUBLE) AS integrated_kwh,
         max(daily) AS max_daily, max(total) - min(total) AS total_span
  FROM generation GROUP BY ALL HAVING max(daily) > 0),
ratios AS (
  SELECT *, max_daily / nullif(integrated_kwh, 0) AS r, abs(total_span - max_daily) AS diff
  FROM reconciled)"""


def station_span(spark, sf):
    df = profile.station_granularity(generation(spark, sf))
    return df.withColumns({c: ts_text(c) for c in ("start_time", "end_time")})


def counter_span(spark, sf):
    return counters.counter_range(generation(spark, sf), by=("plant",))


def synthesized_plant_power(spark, sf):
    df = generation(spark, sf).withColumn("ts", slot("ts", 900))
    return energy.plant_power(df, decimals=DECIMALS).withColumn("ts", ts_text("ts"))


def plant_metric_matrix(spark, sf):
    readings = generation(spark, sf)
    scope_rows = profile.metric_rows(
        profile.scope_profile(readings, by="plant"),
        metrics=("row_count", "distinct_devices", "calendar_days"),
    )
    counter_rows = profile.metric_rows(
        counters.counter_range(readings, by=("plant",)), metrics=("min_counter", "max_counter")
    )
    irradiance_rows = profile.metric_rows(
        profile.irradiance_profile(weather(spark, sf), by="plant"),
        metrics=("median_all", "max_val"),
    )
    rows = scope_rows.unionByName(counter_rows).unionByName(irradiance_rows)
    return profile.plant_matrix(rows, PLANTS)


def _matrix_sql() -> str:
    cells = ", ".join(f"max(CASE WHEN plant = '{p}' THEN value END) AS {p}" for p in PLANTS)
    metrics = {
        "row_count": "count(*)",
        "distinct_devices": "count(DISTINCT device)",
        "calendar_days": "date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1",
        "min_counter": "min(total)",
        "max_counter": "max(total)",
        "median_all": q.rounded("quantile_cont(k / CAST(100 AS DOUBLE), 0.5)", 4),
        "max_val": q.rounded("max(k / CAST(100 AS DOUBLE))", 4),
    }
    rows = " UNION ALL ".join(
        f"SELECT plant, '{name}' AS metric, CAST({expr} AS DOUBLE) AS value FROM generation GROUP BY plant"
        for name, expr in metrics.items()
    )
    return f"WITH {GENERATION_SQL}, cells AS ({rows}) SELECT metric, {cells} FROM cells GROUP BY metric"


def _steps(spark, sf):
    return counters.counter_step(generation(spark, sf), keys=("plant", "device"))


def counter_steps(spark, sf):
    return _steps(spark, sf).select(
        "reading_id", "device", ts_text("ts").alias("ts"), "total", round_half_up("step", 4).alias("step")
    )


def counter_resets(spark, sf):
    return counters.counter_resets(_steps(spark, sf)).select(
        "reading_id", "device", round_half_up("step", 4).alias("step")
    )


def monotonic_verdict(spark, sf):
    df = counters.monotonic_verdict(_steps(spark, sf))
    return df.withColumn("is_monotonic", flag("is_monotonic"))


def counter_reset_samples(spark, sf):
    df = counters.counter_reset_samples(_steps(spark, sf), n=8)
    return df.withColumns({"ts": ts_text("ts"), "step": round_half_up("step", 4)})


STEPS_SQL = f"""
WITH {GENERATION_SQL},
steps AS (
  SELECT *, total - lag(total) OVER (PARTITION BY plant, device ORDER BY ts) AS step FROM generation)"""


def lifetime_counter_flags(spark, sf):
    df = counters.qc_monotonic_total(generation(spark, sf), keys=("plant", "device"))
    return df.select("reading_id", F.coalesce("qc_flag", F.lit("")).alias("qc_flag"))


def daily_drop_flags(spark, sf):
    readings = generation(spark, sf)
    df = counters.qc_daily_drop(
        readings.where(F.col("plant") != "error"), weather_of_errors(spark, sf)
    )
    return df.select(
        "reading_id",
        flag("daily_drop").alias("daily_drop"),
        F.coalesce("qc_flag", F.lit("")).alias("qc_flag"),
    )


def weather_of_errors(spark, sf):
    """Irradiance readings of the plants: error events stand for the station of every plant."""
    errors = table(spark, sf, "events").where(F.col("event_type") == "error")
    plants = F.explode(F.array(*[F.lit(p) for p in PLANTS]))
    g = (F.get_json_object("props", "$.k").cast("int") - 50).cast("double")
    return errors.select(plants.alias("plant"), "ts", g.alias("irradiance"))


DAILY_DROP_SQL = f"""
WITH {GENERATION_SQL},
sun AS (
  SELECT time_bucket(INTERVAL '15 minutes', ts) AS s, max({q.K} - 50) AS g
  FROM events WHERE event_type = 'error' GROUP BY 1),
steps AS (
  SELECT *, coalesce(daily < lag(daily) OVER (PARTITION BY plant, device, local_date ORDER BY ts), false) AS fell
  FROM generation WHERE plant <> 'error'),
judged AS (
  SELECT reading_id, CASE WHEN NOT fell THEN false ELSE g > 0 END AS drop_flag
  FROM steps LEFT JOIN sun ON s = time_bucket(INTERVAL '15 minutes', ts))
SELECT reading_id, {q.flag('drop_flag')} AS daily_drop,
       CASE WHEN drop_flag THEN 'QC_FLAG_DAILY_ENERGY_DROP' ELSE '' END AS qc_flag FROM judged"""


def arrival_order_flags(spark, sf):
    readings = generation(spark, sf).withColumn(
        "ingest_seq", arrival_number(F.col("reading_id"))
    )
    df = counters.qc_chronology(readings, keys=("plant", "device"))
    return df.select("reading_id", F.coalesce("qc_flag", F.lit("")).alias("qc_flag"))


QUERIES = {
    "raw_time_samples": (
        raw_time_samples,
        f"""WITH {TIME_TEXT_SQL}
        SELECT feed, ts_text AS raw_sample FROM texts
        QUALIFY row_number() OVER (PARTITION BY feed ORDER BY ts_text) <= 3""",
    ),
    "timestamp_verification": (
        timestamp_verification,
        f"""WITH {TIME_TEXT_SQL},
        parsed AS (
          SELECT *, CASE feed WHEN 'events' THEN try_strptime(ts_text, '{ISO_SECONDS}')
                              ELSE try_strptime(ts_text, '{DAY_FIRST}') END AS t FROM texts)
        SELECT feed, CASE feed WHEN 'events' THEN '{ISO_SECONDS}' ELSE '{DAY_FIRST}' END AS format,
               CASE feed WHEN 'events' THEN 'ISO' ELSE 'day first' END AS style,
               count(*) AS total_rows, count(t) AS parsed, count(*) - count(t) AS failed_or_null,
               {q.ts_text('min(t)')} AS earliest, {q.ts_text('max(t)')} AS latest
        FROM parsed GROUP BY feed""",
    ),
    "scope_profile": (
        scope,
        f"""WITH {GENERATION_SQL}
        SELECT plant, count(*) AS row_count, count(DISTINCT device) AS distinct_devices,
               {q.ts_text('min(ts)')} AS min_ts, {q.ts_text('max(ts)')} AS max_ts,
               date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS calendar_days
        FROM generation GROUP BY plant""",
    ),
    "coverage_by_rows": (
        coverage_by_rows,
        f"""WITH {GENERATION_SQL}
        SELECT plant, device, count(*) AS recorded_intervals, {EXPECTED_SLOTS} - count(*) AS missing_intervals,
               {q.rounded(f'CAST(100 AS DOUBLE) * count(*) / {EXPECTED_SLOTS}', 2)} AS coverage_pct
        FROM generation GROUP BY plant, device""",
    ),
    "coverage_by_slots": (
        coverage_by_slots,
        f"""WITH {GENERATION_SQL},
        slots AS (SELECT DISTINCT plant, time_bucket(INTERVAL '15 minutes', ts) AS s FROM generation)
        SELECT plant, count(*) AS recorded_intervals, {EXPECTED_SLOTS} - count(*) AS missing_intervals,
               {q.rounded(f'CAST(100 AS DOUBLE) * count(*) / {EXPECTED_SLOTS}', 2)} AS coverage_pct
        FROM slots GROUP BY plant""",
    ),
    "lowest_coverage": (
        lowest_coverage,
        f"""WITH {GENERATION_SQL}
        SELECT device, count(*) AS recorded_intervals, {EXPECTED_SLOTS} - count(*) AS missing_intervals,
               {q.rounded(f'CAST(100 AS DOUBLE) * count(*) / {EXPECTED_SLOTS}', 2)} AS coverage_pct
        FROM generation GROUP BY device ORDER BY recorded_intervals, device LIMIT 5""",
    ),
    "daily_interval_distribution": (
        daily_intervals,
        f"""WITH {GENERATION_SQL},
        days AS (SELECT plant, device, CAST(ts AS DATE) AS d, count(*) AS cnt FROM generation GROUP BY ALL)
        SELECT plant, count(*) AS total_device_days, min(cnt) AS min_intervals_day,
               {q.rounded('sum(cnt) / CAST(count(*) AS DOUBLE)', 2)} AS avg_intervals_day,
               max(cnt) AS max_intervals_day,
               count(CASE WHEN cnt = {PER_DAY} THEN 1 END) AS full_days,
               count(CASE WHEN cnt < {PER_DAY} THEN 1 END) AS partial_days,
               count(CASE WHEN cnt > {PER_DAY} THEN 1 END) AS over_full_days,
               count(DISTINCT device) * count(DISTINCT d) - count(*) AS missing_device_days
        FROM days GROUP BY plant""",
    ),
    "missing_days_observed": (
        missing_observed,
        f"""WITH {GENERATION_SQL},
        grid AS (
          SELECT a.plant, a.device, b.d
          FROM (SELECT DISTINCT plant, device FROM generation) a
          JOIN (SELECT DISTINCT plant, CAST(ts AS DATE) AS d FROM generation) b USING (plant)),
        seen AS (SELECT DISTINCT plant, device, CAST(ts AS DATE) AS d FROM generation)
        SELECT plant, device, count(*) AS missing_days,
               string_agg({q.day_text('d')}, ', ' ORDER BY d) AS missing_date_list
        FROM grid ANTI JOIN seen USING (plant, device, d) GROUP BY plant, device""",
    ),
    "missing_days_full": (
        missing_full,
        f"""WITH {BULK_SQL},
        span AS (SELECT plant, CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM bulk GROUP BY plant),
        days AS (SELECT plant, CAST(unnest(generate_series(lo, hi, INTERVAL '1 day')) AS DATE) AS d FROM span),
        grid AS (SELECT a.plant, a.device, b.d FROM (SELECT DISTINCT plant, device FROM bulk) a JOIN days b USING (plant)),
        seen AS (SELECT DISTINCT plant, device, CAST(ts AS DATE) AS d FROM bulk)
        SELECT plant, device, count(*) AS missing_days,
               string_agg({q.day_text('d')}, ', ' ORDER BY d) AS missing_date_list
        FROM grid ANTI JOIN seen USING (plant, device, d) GROUP BY plant, device""",
    ),
    "efficiency_profile": (
        efficiency_quantiles,
        f"""WITH {GENERATION_SQL}, {BULK_SQL}, {EFFICIENCY_SQL}
        SELECT label, {q.rounded('min(eff)', 4)} AS min_eff, {q.rounded('quantile_cont(eff, 0.05)', 4)} AS p05_eff,
               {q.rounded('quantile_cont(eff, 0.25)', 4)} AS p25_eff, {q.rounded('quantile_cont(eff, 0.50)', 4)} AS median_eff,
               {q.rounded('quantile_cont(eff, 0.75)', 4)} AS p75_eff, {q.rounded('quantile_cont(eff, 0.95)', 4)} AS p95_eff,
               {q.rounded('max(eff)', 4)} AS max_eff
        FROM effs GROUP BY label""",
    ),
    "scaling_artifact": (
        scaling_check,
        f"""WITH {GENERATION_SQL}, {BULK_SQL}, {EFFICIENCY_SQL},
        m AS (SELECT label, count(eff) AS readings, quantile_cont(eff, 0.5) AS med,
                     count(CASE WHEN eff BETWEEN 0.95 AND 0.99 THEN 1 END) AS in_band FROM effs GROUP BY label)
        SELECT label, readings, {q.rounded('med', 4)} AS median_eff,
               {q.rounded('in_band / CAST(readings AS DOUBLE)', 4)} AS in_band_share,
               CAST(CASE WHEN med BETWEEN 0.95 AND 0.99 OR med <= 0 THEN 0
                         ELSE floor(log10(med / CAST(0.975 AS DOUBLE)) + 0.5) END AS INTEGER) AS dc_scale_exponent
        FROM m""",
    ),
    "irradiance_profile": (
        irradiance_range,
        f"""WITH {WEATHER_SQL}
        SELECT station, {q.rounded('min(irradiation)', 4)} AS min_val,
               {q.rounded('quantile_cont(irradiation, 0.5)', 4)} AS median_all,
               {q.rounded('quantile_cont(CASE WHEN irradiation > 0 THEN irradiation END, 0.5)', 4)} AS median_daylight,
               {q.rounded('quantile_cont(irradiation, 0.99)', 4)} AS p99_val,
               {q.rounded('max(irradiation)', 4)} AS max_val
        FROM weather GROUP BY station""",
    ),
    "device_ratings": (
        device_ratings,
        f"""WITH {BULK_SQL}
        SELECT plant, device, {q.rounded('quantile_cont(dc, 0.99)', 6)} AS p99_dc, {q.rounded('quantile_cont(ac, 0.99)', 6)} AS p99_ac,
               {q.rounded('max(dc)', 6)} AS max_dc, {q.rounded('max(ac)', 6)} AS max_ac
        FROM bulk GROUP BY plant, device""",
    ),
    "rated_capacity": (
        plant_capacity,
        f"""WITH {BULK_SQL},
        r AS (SELECT plant, device, quantile_cont(dc, 0.99) AS p FROM bulk GROUP BY plant, device)
        SELECT plant, count(*) AS num_devices, {q.rounded('min(p)', 2)} AS min_p99_dc_kwp,
               {q.rounded(q.mean('p', 6), 2)} AS avg_p99_dc_kwp, {q.rounded('max(p)', 2)} AS max_p99_dc_kwp,
               {q.rounded(q.total('p', 6), 2)} AS capacity_kwp,
               {q.rounded(q.total('p', 6) + ' / CAST(1000 AS DOUBLE)', 3)} AS capacity_mwp
        FROM r GROUP BY plant""",
    ),
    "specific_yield": (
        daily_specific_yield,
        f"""WITH {BULK_SQL},
        daily AS (SELECT plant, CAST(ts AS DATE) AS d, {q.total('ac', 4)} * CAST(0.25 AS DOUBLE) AS kwh FROM bulk GROUP BY ALL),
        p AS (SELECT plant, min(kwh) AS lo, {q.mean('kwh', 4)} AS av, max(kwh) AS hi FROM daily GROUP BY plant),
        r AS (SELECT plant, device, quantile_cont(dc, 0.99) AS p99 FROM bulk GROUP BY plant, device),
        c AS (SELECT plant, {q.rounded(q.total('p99', 6), 2)} AS kwp FROM r GROUP BY plant),
        s AS (SELECT plant, 'corrected' AS scenario, kwp AS cap FROM c UNION ALL SELECT plant, 'uncorrected', kwp * CAST(10 AS DOUBLE) FROM c)
        SELECT scenario, plant, {q.rounded('lo', 0)} AS min_daily_kwh, {q.rounded('av', 0)} AS avg_daily_kwh,
               {q.rounded('hi', 0)} AS max_daily_kwh, {q.rounded('lo / cap', 3)} AS min_specific_yield,
               {q.rounded('av / cap', 3)} AS avg_specific_yield, {q.rounded('hi / cap', 3)} AS max_specific_yield
        FROM p JOIN s USING (plant)""",
    ),
    "integrated_energy": (
        device_day_energy,
        f"""WITH {BULK_SQL}
        SELECT plant, device, {q.day_text('CAST(ts AS DATE)')} AS log_date,
               {q.total('ac', 4)} * CAST(0.25 AS DOUBLE) AS integrated_kwh
        FROM bulk GROUP BY plant, device, CAST(ts AS DATE)""",
    ),
    "energy_reconciliation": (
        energy_reconciliation,
        f"""WITH {GENERATION_SQL}, {RECONCILED_SQL}
        SELECT plant, device, {q.day_text('d')} AS log_date, integrated_kwh, max_daily,
               {q.rounded('total_span', 6)} AS total_span, {q.rounded('r', 6)} AS ratio_daily_to_integrated,
               {q.rounded('diff', 6)} AS span_vs_daily_diff FROM ratios""",
    ),
    "reconciliation_summary": (
        reconciliation_summary,
        f"""WITH {GENERATION_SQL}, {RECONCILED_SQL}
        SELECT plant, count(*) AS device_days, {q.rounded(q.mean('r', 6), 4)} AS mean_ratio,
               {q.rounded('quantile_cont(r, 0.5)', 4)} AS median_ratio, {q.rounded('max(r)', 4)} AS max_ratio,
               {q.rounded(q.mean('diff', 6), 2)} AS mean_abs_diff,
               count(CASE WHEN integrated_kwh = 0 THEN 1 END) AS n_zero_integrated
        FROM ratios GROUP BY plant""",
    ),
    "station_granularity": (
        station_span,
        f"""WITH {GENERATION_SQL}
        SELECT plant, device, count(*) AS total_readings, {q.ts_text('min(ts)')} AS start_time,
               {q.ts_text('max(ts)')} AS end_time FROM generation GROUP BY plant, device""",
    ),
    "counter_range": (
        counter_span,
        f"""WITH {GENERATION_SQL}
        SELECT plant, min(total) AS min_counter, max(total) AS max_counter FROM generation GROUP BY plant""",
    ),
    "plant_power": (
        synthesized_plant_power,
        f"""WITH {GENERATION_SQL}
        SELECT plant, {q.ts_text("time_bucket(INTERVAL '15 minutes', ts)")} AS ts, {q.total('ac')} AS plant_ac,
               count(ac) AS contributing_devices
        FROM generation GROUP BY plant, time_bucket(INTERVAL '15 minutes', ts)""",
    ),
    "plant_matrix": (plant_metric_matrix, _matrix_sql()),
    "counter_step": (
        counter_steps,
        f"{STEPS_SQL} SELECT reading_id, device, {q.ts_text('ts')} AS ts, total, {q.rounded('step', 4)} AS step FROM steps",
    ),
    "counter_resets": (
        counter_resets,
        f"{STEPS_SQL} SELECT reading_id, device, {q.rounded('step', 4)} AS step FROM steps WHERE step < 0",
    ),
    "monotonic_verdict": (
        monotonic_verdict,
        f"""{STEPS_SQL} SELECT plant, count(CASE WHEN step < 0 THEN 1 END) AS negative_steps,
        {q.flag('count(CASE WHEN step < 0 THEN 1 END) = 0')} AS is_monotonic FROM steps GROUP BY plant""",
    ),
    "counter_reset_samples": (
        counter_reset_samples,
        f"""{STEPS_SQL} SELECT plant, device, {q.ts_text('ts')} AS ts, total, {q.rounded('step', 4)} AS step
        FROM steps WHERE step < 0 ORDER BY plant, device, steps.ts, total LIMIT 8""",
    ),
    "qc_monotonic_total": (
        lifetime_counter_flags,
        f"""WITH {GENERATION_SQL}
        SELECT reading_id, CASE WHEN total < lag(total) OVER (PARTITION BY plant, device ORDER BY ts)
               THEN 'QC_MONOTONIC_INCREASING' ELSE '' END AS qc_flag FROM generation""",
    ),
    "qc_daily_drop": (daily_drop_flags, DAILY_DROP_SQL),
    "qc_chronology": (
        arrival_order_flags,
        f"""WITH {GENERATION_SQL}
        SELECT reading_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY plant, device ORDER BY reading_id + reading_id % 7 * 1001)
               THEN 'QC_FLAG_NOT_CHRONOLOGICAL' ELSE '' END AS qc_flag FROM generation""",
    ),
}
