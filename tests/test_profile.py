from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helioquant.functions.numeric import round_half_up, total
from helioquant.operators import counters, energy, profile

SCHEMA = "plant string, device string, ts timestamp, dc double, ac double, daily double, total double"


@pytest.fixture
def readings(frame):
    rows = []

    def add(device, day, slots, base=0.0, plant="p"):
        for i in range(slots):
            ts = f"2020-05-{day:02d} {i // 4:02d}:{i % 4 * 15:02d}:00"
            rows.append((plant, device, ts, 100.0 + i, 10.0 + i, float(i), base + i))

    add("a", 1, 96)
    add("a", 2, 95, 1000.0)
    add("a", 5, 96, 2000.0)
    rows.append(("p", "a", "2020-05-05 00:00:00", 1.0, 1.0, 0.0, 2000.0))  # a repeated slot
    add("b", 1, 10)
    add("b", 5, 96, 50.0)
    add("z", 4, 2, plant="q")
    return frame(rows, SCHEMA)


def test_scope(readings):
    rows = {r.plant: r for r in profile.scope_profile(readings, by="plant").collect()}
    assert (rows["p"].row_count, rows["p"].distinct_devices, rows["p"].calendar_days) == (394, 2, 5)
    approx = {r.plant: r for r in profile.scope_profile(readings, by="plant", approx=True).collect()}
    assert approx["p"].distinct_devices == 2


def test_coverage_and_missing_add_up(readings):
    out = profile.device_coverage(readings, expected=480).collect()
    assert [r.device for r in out] == ["z", "b", "a"]
    assert all(r.recorded_intervals + r.missing_intervals == 480 for r in out)
    assert out[1].coverage_pct == 22.08
    a = profile.device_coverage(readings, 480, distinct_slots=True).where("device = 'a'").first()
    assert a.recorded_intervals == 287  # the repeated slot counts once
    assert len(profile.device_coverage(readings, 480, top_n=2).collect()) == 2


def test_daily_distribution(readings):
    row = profile.daily_interval_distribution(readings, 2, 5).where("plant = 'p'").first()
    assert (row.total_device_days, row.full_days, row.partial_days, row.over_full_days) == (5, 2, 2, 1)
    assert (row.min_intervals_day, row.max_intervals_day, row.missing_device_days) == (10, 97, 5)
    assert row.avg_intervals_day == 78.8


def test_missing_days(readings):
    observed = {r.device: r for r in profile.missing_days(readings).collect()}
    assert set(observed) == {"b"}
    assert (observed["b"].missing_days, observed["b"].missing_date_list) == (1, "2020-05-02")
    full = profile.missing_days(readings, calendar="full").collect()
    assert [(r.device, r.missing_date_list) for r in full] == [
        ("b", "2020-05-02, 2020-05-03, 2020-05-04"), ("a", "2020-05-03, 2020-05-04"),
    ]
    with pytest.raises(ValueError):
        profile.missing_days(readings, calendar="lunar")


def test_efficiency_floors_and_factors(frame):
    rows = [("p", 1000.0, 97.0), ("p", 100.0, 50.0), ("p", 500.0, 10.0), ("p", 2000.0, 195.0), ("p", 0.0, 11.0)]
    df = frame(rows, "plant string, dc double, ac double")
    assert sorted(r.eff for r in profile.efficiency(df, 100, 10).collect()) == [0.097, 0.0975]
    both = profile.efficiency_variants(df, 100, 10, {"raw": 1.0, "fixed": 0.1})
    table = {r.label: r for r in profile.efficiency_profile(both).collect()}
    assert table["raw"].median_eff == 0.0973 and table["fixed"].median_eff == 0.9725
    found = {r.label: r for r in profile.scaling_artifact(both, by="label").collect()}
    assert (found["raw"].dc_scale_exponent, found["fixed"].dc_scale_exponent) == (-1, 0)
    assert (found["raw"].in_band_share, found["fixed"].in_band_share) == (0.0, 1.0)


def test_irradiance(frame):
    df = frame([("w", 0.0), ("w", 0.0), ("w", 0.4), ("w", 1.0), ("w", None)], "station string, irradiation double")
    row = profile.irradiance_profile(df).first()
    assert (row.min_val, row.median_all, row.median_daylight, row.max_val) == (0.0, 0.2, 0.7, 1.0)


def test_capacity_and_yield(spark, readings):
    ratings = profile.device_ratings(readings, dc_scale=0.1)
    row = profile.rated_capacity(ratings).where("plant = 'p'").first()
    p99 = {r.device: r.p99_dc for r in ratings.where("plant = 'p'").collect()}
    assert row.num_devices == 2
    assert row.capacity_kwp == pytest.approx(sum(p99.values()), abs=0.01)
    assert row.capacity_mwp == pytest.approx(sum(p99.values()) / 1000, abs=0.001)
    scenarios = profile.scenario_table(spark, [("p", "right", 1000.0), ("p", "ten times", 10000.0)])
    out = {r.scenario: r for r in profile.specific_yield(readings, scenarios).collect()}
    assert set(out) == {"right", "ten times", None}
    # A plant that no scenario names keeps its energies.
    assert out[None].plant == "q" and out[None].max_daily_kwh is not None and out[None].max_specific_yield is None
    assert out["right"].max_specific_yield == pytest.approx(10 * out["ten times"].max_specific_yield, abs=0.01)
    assert out["right"].min_daily_kwh <= out["right"].avg_daily_kwh <= out["right"].max_daily_kwh


def test_matrix(readings):
    rows = profile.metric_rows(counters.counter_range(readings, by=("plant",)))
    out = {r.metric: (r.p, r.q) for r in profile.plant_matrix(rows, ["p", "q"]).collect()}
    assert out == {"min_counter": (0.0, 0.0), "max_counter": (2095.0, 1.0)}


def test_station_granularity(readings):
    row = profile.station_granularity(readings).where("device = 'b'").first()
    assert row.total_readings == 106 and str(row.end_time) == "2020-05-05 23:45:00"


def test_device_energies_add_up_to_the_plant(readings):
    devices = energy.integrated_energy(readings).groupBy("plant").agg(F.sum("integrated_kwh").alias("e"))
    plants = energy.plant_power(readings).groupBy("plant").agg((F.sum("plant_ac") * 0.25).alias("e"))
    a = {r.plant: r.e for r in devices.collect()}
    b = {r.plant: r.e for r in plants.collect()}
    assert a == pytest.approx(b)
    fixed = energy.integrated_energy(readings, decimals=2).groupBy("plant").agg(F.sum("integrated_kwh").alias("e"))
    assert {r.plant: r.e for r in fixed.collect()} == pytest.approx(a)
    at_noon = energy.plant_power(readings).where("ts = TIMESTAMP'2020-05-05 12:00:00'").first()
    assert at_noon.contributing_devices == 2


def test_reconciliation(frame):
    rows = [
        ("p", "a", "2020-05-01 10:00:00", 0.0, 4.0, 1.0, 100.0),
        ("p", "a", "2020-05-01 10:15:00", 0.0, 8.0, 3.0, 103.0),
        ("p", "a", "2020-05-02 10:00:00", 0.0, 0.0, 2.0, 103.0),  # nothing integrated
        ("p", "b", "2020-05-01 10:00:00", 0.0, 8.0, 0.0, 7.0),  # daily counter stayed at zero
    ]
    out = energy.reconcile_energy(frame(rows, SCHEMA))
    got = {str(r.log_date): r for r in out.collect()}
    assert set(got) == {"2020-05-01", "2020-05-02"}
    assert got["2020-05-01"].ratio_daily_to_integrated == 1.0 and got["2020-05-01"].span_vs_daily_diff == 0.0
    assert got["2020-05-02"].ratio_daily_to_integrated is None
    row = energy.reconciliation_summary(out).first()
    assert (row.device_days, row.mean_ratio, row.median_ratio, row.n_zero_integrated) == (2, 1.0, 1.0, 1)
    assert row.mean_abs_diff == 1.0


def test_counter_rules(frame):
    rows = [
        ("p", "a", "2020-05-01 10:00:00", 0.0, 0.0, 1.0, 10.0),
        ("p", "a", "2020-05-01 10:15:00", 0.0, 0.0, 1.0, 10.0),  # equal passes
        ("p", "a", "2020-05-02 00:15:00", 0.0, 0.0, 0.0, 9.0),  # falls over midnight
        ("p", "b", "2020-05-01 10:00:00", 0.0, 0.0, 0.0, 5.0),
        ("q", "c", "2020-05-01 10:00:00", 0.0, 0.0, 0.0, 1.0),
    ]
    steps = counters.counter_step(frame(rows, SCHEMA))
    assert [(r.device, r.step) for r in counters.counter_reset_samples(steps).collect()] == [("a", -1.0)]
    assert counters.counter_resets(steps).count() == 1
    verdict = {r.plant: (r.negative_steps, r.is_monotonic) for r in counters.monotonic_verdict(steps).collect()}
    assert verdict == {"p": (1, False), "q": (0, True)}
    assert steps.where("step IS NULL").count() == 3
    flagged = counters.qc_monotonic_total(frame(rows, SCHEMA)).where("qc_flag IS NOT NULL").collect()
    assert [str(r.ts) for r in flagged] == ["2020-05-02 00:15:00"]


def test_rounding_and_totals(spark):
    df = spark.createDataFrame([(1.005,), (0.285,), (-2.5,), (None,)], "x double")
    out = [r.r for r in df.select("x", round_half_up("x", 2).alias("r")).orderBy("x").collect()]
    assert out == [None, -2.5, 0.28, 1.0]
    assert df.agg(total("x", 3).alias("s")).first().s == -1.21


def test_devices_without_a_plant_have_outages_too(frame):
    rows = [(None, "a", "2020-05-01 10:00:00"), (None, "b", "2020-05-02 10:00:00"), ("p", "c", "2020-05-01 10:00:00")]
    out = {r.device: r.missing_date_list for r in profile.missing_days(frame(rows, "plant string, device string, ts timestamp")).collect()}
    assert out == {"a": "2020-05-02", "b": "2020-05-01"}


def test_device_days_are_those_of_the_data(frame):
    rows = [("p", d, f"2020-05-0{k} 10:00:00") for d, k in (("a", 1), ("a", 2), ("b", 2), ("c", 3))] + [("q", "a", "2020-05-01 10:00:00")]
    table = profile.daily_interval_distribution(frame(rows, "plant string, device string, ts timestamp"), per_day=1)
    assert {r.plant: r.missing_device_days for r in table.collect()} == {"p": 5, "q": 0}


def test_clock_grid(frame):
    rows = [("p", "d", t) for t in ("2024-01-01 00:00:00", "2024-01-01 00:15:00", "2024-01-01 00:17:30", "2024-01-01 01:00:00", None, None)]
    rows += [(None, "e", "2024-01-01 00:01:00"), ("p", None, None)]
    out = {(r.plant, r.device): tuple(r)[2:] for r in profile.clock_grid(frame(rows, "plant string, device string, ts timestamp")).collect()}
    assert out == {
        ("p", "d"): (6, 2, 3, 1, 150.0, 1, 2),
        (None, "e"): (1, 0, 0, 1, 60.0, 0, 0),
        ("p", None): (1, 1, 0, 0, None, 0, 0),
    }
    assert profile.clock_grid(frame([], "plant string, device string, ts timestamp")).collect() == []
