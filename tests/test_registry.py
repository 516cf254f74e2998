from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helioquant.operators import canonical, dictionary, registry


@pytest.fixture
def devices(spark):
    rows = [("solar-1", f"{c}key{i:02d}", "inverter", 1285.48, 1250.0) for i, c in enumerate("zaZAbB19cCdDeEfFgGhHiI")]
    rows += [("solar-1", "station", "weather_station", None, None)]
    return spark.createDataFrame(
        rows + rows[:3],  # repeated listings name a device once
        "plant_id string, source_key string, asset_type string, rated_dc_kwp double, rated_ac_kw double",
    )


@pytest.fixture
def assets(devices):
    return registry.build_assets(devices)


@pytest.fixture
def channels(spark, assets):
    return registry.build_channels(assets, dictionary.channel_templates(spark, dictionary.DC_TENTHS_OF_KW))


def test_tree_shape(assets):
    kinds = {r.asset_type: r["count"] for r in assets.groupBy("asset_type").count().collect()}
    assert kinds == {"block": 1, "inverter": 22, "weather_station": 1}
    block = assets.where("asset_type = 'block'").first()
    assert block.parent_id is None and block.name == "Block-01"
    assert assets.where(F.col("parent_id") == block.id).count() == 23
    names = [r.name for r in assets.where("asset_type = 'inverter'").orderBy("source_key").collect()]
    assert names == [f"INV-{i:02d}" for i in range(1, 23)]
    # Digits sort before capitals, capitals before small letters.
    keys = [r.source_key[0] for r in assets.where("asset_type = 'inverter'").orderBy("name").collect()]
    assert keys == sorted(keys)
    station = assets.where("asset_type = 'weather_station'").first()
    assert station.name == "WS-01" and station.approx_ghi and station.poa_assumed
    assert assets.where("name = 'INV-01'").first().rated_dc_w == 1285480.0


def test_channels(assets, channels):
    assert channels.count() == 91
    counts = registry.registry_counts(assets, channels).collect()
    assert [(r.total_assets, r.total_channels) for r in counts] == [(24, 91)]
    methods = {r.signal_key: (r.aggregation_method, r.scale_factor) for r in channels.collect()}
    assert methods["power_dc"] == ("avg", 100.0) and methods["power_ac"] == ("avg", 1000.0)
    assert methods["energy_ac_daily"] == ("sum", 1000.0) and methods["energy_ac_total"] == ("last", 1000.0)
    assert {r.interval_s for r in channels.collect()} == {900}
    assert channels.where("signal_key = 'power_dc' AND source_unit = 'deci-kW'").count() == 22


def test_second_run_changes_nothing(devices, assets):
    again = registry.build_assets(devices)
    assert sorted(again.collect(), key=str) == sorted(assets.collect(), key=str)
    merged = registry.insert_if_absent(assets, again, ["id"])
    assert merged.count() == 24
    assert {r.id for r in merged.collect()} == {r.id for r in assets.collect()}


def test_sound_registry_has_no_violations(spark, assets, channels):
    plants = spark.createDataFrame([("solar-1", "org", "One")], "id string, organization_id string, name string")
    signals = dictionary.canonical_signals(spark)
    assert registry.check_constraints(plants, assets, channels, signals).count() == 0
    doubled = channels.unionByName(channels.where("signal_key = 'power_ac'"))
    few = signals.where("signal_key <> 'irradiance_poa'")
    twice = plants.unionByName(plants.withColumn("id", F.lit("solar-2")))
    out = registry.check_constraints(twice, assets, doubled, few)
    kinds = {r.constraint: r["count"] for r in out.groupBy("constraint").count().collect()}
    assert kinds == {"channel_signal_unique": 22, "channel_signal_exists": 1, "plant_name_unique": 1}


def test_cascade_and_rebuild(spark, devices, assets, channels):
    plants = spark.createDataFrame([("solar-1",), ("solar-2",)], "id string")
    other = registry.build_assets(devices.withColumn("plant_id", F.lit("solar-2")))
    other_channels = registry.build_channels(other, dictionary.channel_templates(spark))
    left = registry.delete_cascade(
        plants, assets.unionByName(other), channels.unionByName(other_channels), ["solar-1"]
    )
    assert [df.count() for df in left] == [1, 24, 91]
    rebuilt = registry.insert_if_absent(left[1], assets, ["id"])
    assert registry.orphans(rebuilt, "parent_id", rebuilt, "id", "x").count() == 0
    assert rebuilt.count() == 48


def test_upsert(spark):
    target = spark.createDataFrame([("a", 1, "t0", "t0"), ("b", 2, "t0", "t0")], "k string, v int, c string, u string")
    updates = spark.createDataFrame([("b", 20), ("n", 30)], "k string, v int")
    out = registry.upsert(target, updates, ["k"], "c", "u", F.lit("t1"))
    assert sorted(tuple(r) for r in out.collect()) == [
        ("a", 1, "t0", "t0"), ("b", 20, "t0", "t1"), ("n", 30, "t1", "t1"),
    ]
    plain = registry.upsert(target.select("k", "v"), updates, ["k"])
    assert sorted(tuple(r) for r in plain.collect()) == [("a", 1), ("b", 20), ("n", 30)]
    kept = registry.insert_if_absent(target.select("k", "v"), updates.unionByName(updates), ["k"])
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 1), ("b", 2), ("n", 30)]


def test_dictionary_switches(spark):
    before = dictionary.canonical_signals(spark, with_wind=True)
    assert before.where("is_active").count() == 8 and before.count() == 16
    off = registry.set_active(before, ["power_ac"], False)
    assert off.where("is_active").count() == 7
    on = registry.set_active(off, dictionary.WIND_KEYS, True)
    assert on.where("is_active").count() == 15
    back = registry.restore(on, before, ["power_ac", *dictionary.WIND_KEYS])
    assert sorted(back.collect(), key=str) == sorted(before.collect(), key=str)
    without = before.where("signal_key <> 'power_ac'")
    assert registry.restore(on, without, ["power_ac"]).where("signal_key = 'power_ac'").count() == 0


def test_raw_to_canonical(frame, spark, assets, channels):
    rows = [("solar-1", "zkey00", "2020-05-01 10:00:00", "2020-05-01", 12850.0, 1250.0, None)]
    wide = frame(rows, "plant string, device string, ts timestamp, local_date date, dc double, ac double, daily double")
    long = canonical.to_long(wide, {"dc": "DC_POWER", "ac": "AC_POWER", "daily": "DAILY_YIELD"})
    out = {r.signal_key: (r.value, r.unit) for r in canonical.canonicalize(long, channels).collect()}
    assert out == {"power_dc": (1285000.0, "W"), "power_ac": (1250000.0, "W"), "energy_ac_daily": (None, "Wh")}
    stranger = long.withColumn("device", F.lit("who"))
    assert [r.signal_key for r in canonical.canonicalize(stranger, channels).collect()] == [None] * 3
    named = registry.map_devices(wide, assets).first()
    assert named.asset_plant_id == "solar-1" and named.asset_name.startswith("INV-")


def test_rollup_by_method(frame, spark):
    rows = [("d", s, f"2020-05-01 10:{m:02d}:00", v) for s in ("x", "y", "z") for m, v in ((0, 1.0), (15, 5.0), (30, 3.0))]
    df = frame(rows, "device string, signal_key string, ts timestamp, value double")
    methods = spark.createDataFrame([("d", "x", "avg"), ("d", "y", "sum"), ("d", "z", "last")], "device string, signal_key string, aggregation_method string")
    out = {r.signal_key: (r.value, r.n_readings) for r in canonical.rollup_channels(df, methods).collect()}
    assert out == {"x": (3.0, 3), "y": (9.0, 3), "z": (3.0, 3)}


def test_tags_and_classes(spark, channels):
    readings = spark.createDataFrame([("station", "irradiance_poa"), ("zkey00", "power_ac"), ("who", "irradiance_poa")], "device string, signal_key string")
    out = {(r.device, r.signal_key): (r.approx_ghi, r.poa_assumed) for r in canonical.tag_irradiance(readings, channels).collect()}
    assert out == {
        ("station", "irradiance_poa"): (True, True), ("zkey00", "power_ac"): (False, False), ("who", "irradiance_poa"): (False, False),
    }
    columns = spark.createDataFrame([("DC_POWER",), ("PLANT_ID",), ("STRING_CURRENT",)], "source_name string")
    roles = {r.source_name: (r.role, r.target) for r in canonical.classify_columns(columns, dictionary.raw_mapping(spark)).collect()}
    assert roles == {"DC_POWER": ("signal", "power_dc"), "PLANT_ID": ("dimension", "plant_id"), "STRING_CURRENT": ("unmapped", None)}


def test_a_device_added_later_changes_no_id(spark):
    schema = "plant_id string, source_key string, asset_type string, rated_dc_kwp double, rated_ac_kw double"
    rows = [("p", k, "inverter", 10.0, 8.0) for k in ("b", "c")] + [("q", "b", "inverter", 10.0, 8.0)]
    before = {(r.plant_id, r.source_key): r.id for r in registry.build_assets(spark.createDataFrame(rows, schema)).collect()}
    more = registry.build_assets(spark.createDataFrame([*rows, ("p", "a", "inverter", 10.0, 8.0)], schema))
    after = {(r.plant_id, r.source_key): r.id for r in more.collect()}
    assert before.items() <= after.items() and len(set(after.values())) == len(after)
    readings = spark.createDataFrame([("p", "b", 1.0), ("q", "b", 2.0), (None, "b", 3.0)], "plant string, device string, value double")
    named = registry.map_devices(readings, more, plant="plant").collect()
    assert sorted((r.value, r.asset_plant_id) for r in named) == [(1.0, "p"), (2.0, "q"), (3.0, None)]


def test_rows_with_null_keys_stay(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "signal_key string, v int")
    old = spark.createDataFrame([("a", 9)], "signal_key string, v int")
    assert sorted(registry.restore(table, old, ["a"]).select("v").toPandas().v) == [2, 3, 9]
    plants = spark.createDataFrame([("p",), (None,)], "id string")
    assets = spark.createDataFrame([("x", "p"), ("y", None)], "id string, plant_id string")
    channels = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, asset_id string")
    left = registry.delete_cascade(plants, assets, channels, ["p"])
    assert [df.select("id").first()[0] for df in left] == [None, "y", "2"] and [df.count() for df in left] == [1, 1, 1]


def test_the_latest_of_several_updates_counts(spark):
    target = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, at int")
    updates = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("c", 8, 1), ("c", 6, 3)], "k string, v int, at int")
    out = registry.upsert(target, updates, ["k"], latest="at")
    assert sorted(map(tuple, out.select("k", "v").collect())) == [("a", 7), ("b", 2), ("c", 6)]
    added = registry.insert_if_absent(target, updates, ["k"], latest="at")
    assert sorted(map(tuple, added.select("k", "v").collect())) == [("a", 1), ("b", 2), ("c", 6)]


def test_plant_ids(spark):
    ids = dictionary.plant_ids(spark, [("4135001", "surya_a"), (" 7", "north"), ("7", "south")])
    rows = [(4135001, "x"), (7, "y"), (8, "z"), (None, "w")]
    out = registry.map_plants(spark.createDataFrame(rows, "plant_id int, device string"), ids)
    assert out.columns == ["plant_id", "device", "plant"]
    assert {r.device: r.plant for r in out.collect()} == {"x": "surya_a", "y": "north", "z": None, "w": None}
    replaced = registry.map_plants(spark.createDataFrame([("4135001 ", "old")], "plant_id string, plant string"), ids)
    assert [tuple(r) for r in replaced.collect()] == [("4135001 ", "surya_a")]
    trimmed = ids.withColumn("raw_plant_id", F.trim("raw_plant_id"))
    assert [r.key for r in registry.repeated_keys(trimmed, ["raw_plant_id"], "plant_id_unique").collect()] == ["7"]
