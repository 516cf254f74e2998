from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from helioquant.functions import units
from helioquant.functions.units import UnknownConversionError, convert, normalize_unit


def spellings():
    """Every spelling on file in several guises: case, blanks around, blanks doubled inside."""
    for key, unit in units.LOOKUP.items():
        for text in (key, key.upper() if key.upper() not in units.DIMENSION_OF else key, f"\t{key} ", key.replace(" ", "  ")):
            yield text, unit
    for unit in units.DIMENSION_OF:
        yield unit, unit
        yield f" {unit}\n", unit


KNOWN = sorted(set(spellings()))
UNKNOWN = ["parsec", "kW per day", "m2/kW", "\t", "", "Wh!", "deg", "degrees of doubt"]


@pytest.mark.parametrize(("raw", "expected"), KNOWN)
def test_known_spellings(raw, expected):
    assert normalize_unit(raw) == expected


@pytest.mark.parametrize("raw", UNKNOWN)
def test_unknown_spellings(raw):
    with pytest.raises(UnknownConversionError) as caught:
        normalize_unit(raw)
    assert caught.value.from_unit == raw


def test_unit_must_be_text():
    with pytest.raises(UnknownConversionError, match="given as text"):
        normalize_unit(3)


def test_column_agrees_with_driver(spark):
    rows = [(raw, want) for raw, want in KNOWN] + [(raw, None) for raw in UNKNOWN] + [(None, None)]
    df = spark.createDataFrame(rows, "raw string, want string")
    out = df.withColumn("got", units.normalize_unit_expr("raw"))
    assert out.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


CASES = [
    (3.75, "MW", "kW", 3750.0), (640.0, "W", "kW", 0.64), (8.4, "kWh", "Wh", 8400.0),
    (96.0, "kWh", "MWh", 0.096), (0.731, "kW/m²", "W/m²", 731.0), (415.0, "W/m²", "kW/m²", 0.415),
    (68.0, "degF", "degC", 20.0), (15.0, "degC", "degF", 59.0), (310.15, "K", "degC", 37.0), (-3.0, "degC", "K", 270.15),
    (14.0, "degF", "K", 263.15), (61.25, "kW", "kW", 61.25),
]


@pytest.mark.parametrize(("value", "source", "target", "expected"), CASES)
def test_numbers(value, source, target, expected):
    assert convert(value, source, target) == pytest.approx(expected)


# Written out by hand: what 6 of the first unit are in the second.
FACTORS = [
    ("W", "kW", 0.006), ("kW", "W", 6000.0), ("W", "MW", 0.000006), ("MW", "W", 6000000.0), ("kW", "MW", 0.006),
    ("MW", "kW", 6000.0), ("W", "GW", 0.000000006), ("GW", "W", 6000000000.0),
    ("Wh", "kWh", 0.006), ("kWh", "Wh", 6000.0), ("Wh", "MWh", 0.000006), ("MWh", "Wh", 6000000.0), ("kWh", "MWh", 0.006),
    ("MWh", "kWh", 6000.0), ("kWh", "GWh", 0.000006), ("GWh", "kWh", 6000000.0),
    ("W/m²", "kW/m²", 0.006), ("kW/m²", "W/m²", 6000.0), ("degC", "degF", 42.8), ("degF", "degC", -14.444444444444445),
    ("degC", "K", 279.15), ("K", "degC", -267.15), ("degF", "K", 258.7055555555556), ("K", "degF", -448.87),
]


@pytest.mark.parametrize(("source", "target", "expected"), FACTORS)
def test_factors_written_out(source, target, expected):
    assert convert(6.0, source, target) == pytest.approx(expected, rel=1e-12)


def test_factors_are_all_pairs():
    assert {(s, t) for s, t, _ in FACTORS} == {pair for pair in units._PAIRS if pair[0] != pair[1]}


# Written out by hand: spellings and the unit that a reader would take them for.
NAMES = [
    ("w", "W"), ("Watts", "W"), ("KILOWATT", "kW"), ("kilowatts", "kW"), ("mw", "MW"), ("megawatts", "MW"), ("Gigawatt", "GW"),
    ("whr", "Wh"), ("watt_hour", "Wh"), ("kWhr", "kWh"), ("kilowatt-hours", "kWh"), ("megawatthour", "MWh"), ("gwh", "GWh"),
    ("W/m^2", "W/m²"), ("watts/m2", "W/m²"), ("w / m²", "W/m²"), ("kilowatt/m2", "kW/m²"), ("KW / M^2", "kW/m²"),
    ("Celsius", "degC"), ("deg C", "degC"), ("degree c", "degC"), ("centigrade", "degC"), ("°f", "degF"), ("degrees F", "degF"),
    ("kelvin", "K"), ("k", "K"),
]


@pytest.mark.parametrize(("raw", "expected"), NAMES)
def test_names_written_out(raw, expected):
    assert normalize_unit(raw) == expected


def test_converters_of_one_call(spark):
    before = dict(units._PAIRS)
    df = spark.createDataFrame([(5.0, "MW", "GW"), (5.0, "kW", "W"), (5.0, "K", "kelvin")], "value double, unit string, target_unit string")
    out = units.convert_readings(df, converters={("megawatt", "gw"): units.Affine(div=1e3), ("kW", "W"): lambda v: v * 2})
    assert [r.converted for r in out.collect()] == [0.005, 10.0, 5.0]
    assert units._PAIRS == before
    assert units.convert_readings(df).first().conversion_error == "no conversion on file"


def test_all_24_pairs_have_their_inverse(spark):
    pairs = [pair for pair in units._PAIRS if pair[0] != pair[1]]
    assert len(pairs) == 24
    values = spark.createDataFrame([(v * 37.5 - 60,) for v in range(50)], "v double")
    for source, target in pairs:
        there = convert(F.col("v"), source, target)
        back = convert(there, target, source)
        worst = values.select(F.max(F.abs(back - F.col("v"))).alias("d")).first().d
        assert worst < 1e-9, (source, target)


def test_columns_keep_name_order_and_nulls(spark):
    df = spark.createDataFrame([("p", None, 7.0), ("q", 12.5, 8.0), ("r", -2.0, None)], "tag string, t double, e double")
    out = units.convert_columns(df, {"e": ("MWh", "kWh"), "t": ("degC", "K")})
    assert out.columns == df.columns
    assert [tuple(r) for r in out.orderBy("tag").collect()] == [("p", None, 7000.0), ("q", 285.65, 8000.0), ("r", 271.15, None)]
    assert units.convert_columns(df.limit(0), {"e": ("MWh", "kWh")}).count() == 0


def test_failures_while_planning():
    by_dimension = {}
    for unit, dimension in units.DIMENSION_OF.items():
        by_dimension.setdefault(dimension, []).append(unit)
    dimensions = sorted(by_dimension)
    for one, other in zip(dimensions, dimensions[1:]):
        with pytest.raises(UnknownConversionError, match="dimensions differ"):
            convert(F.lit(1.0), by_dimension[one][0], by_dimension[other][-1])
    for group in by_dimension.values():
        for source in group:
            for target in group:
                if source != target and (source, target) not in units._PAIRS:
                    with pytest.raises(UnknownConversionError, match="no conversion on file"):
                        convert(F.lit(1.0), source, target)
    with pytest.raises(UnknownConversionError, match="'furlong' is not a unit"):
        convert(F.lit(1.0), "W", "furlong")
    with pytest.raises(UnknownConversionError, match="no unit given"):
        convert(F.lit(1.0), "\n", "W")


def test_only_numbers_and_columns_are_converted():
    with pytest.raises(TypeError, match="cannot convert a list"):
        convert([1.0], "kW", "W")


def test_row_by_row(spark):
    rows = [(str(v), s, t) for v, s, t, _ in CASES]
    rows += [("x", "kW", "W"), ("1", "kW", "degC"), ("1", "", "W"), ("1", None, "W"), ("1", "kW", "GW"), (None, "kW", "W")]
    df = spark.createDataFrame(rows, "value string, unit string, target_unit string")
    out = units.convert_readings(df).collect()
    assert len(out) == len(rows)
    found = {(r.value, r.unit, r.target_unit): r for r in out}
    for value, source, target, expected in CASES:
        row = found[(str(value), source, target)]
        assert row.converted == pytest.approx(expected) and row.conversion_error is None
    assert found[("x", "kW", "W")].conversion_error == "not a number"
    assert found[("1", "kW", "degC")].conversion_error == "dimensions differ"
    assert "empty" in found[("1", "", "W")].conversion_error
    assert "empty" in found[("1", None, "W")].conversion_error
    assert found[("1", "kW", "GW")].conversion_error == "no conversion on file"
    assert found[(None, "kW", "W")].converted is None
    with pytest.raises(UnknownConversionError, match="given as text"):
        units.convert_readings(spark.createDataFrame([(1.0, 2, "W")], "value double, unit int, target_unit string"))


def test_registered_conversions(spark, monkeypatch):
    monkeypatch.setattr(units, "_PAIRS", dict(units._PAIRS))
    units.register_conversion("kilowatt", "gw", units.Affine(div=1e6))
    assert convert(2e6, "kW", "GW") == 2.0
    units.register_conversion("Wh", "GWh", lambda v: v / 1e9 + 1)
    df = spark.createDataFrame([(1e9, "Wh", "GWh"), (2e6, "kW", "GW")], "value double, unit string, target_unit string")
    out = {r.unit: r.converted for r in units.convert_readings(df).collect()}
    assert out == {"Wh": 2.0, "kW": 2.0}
