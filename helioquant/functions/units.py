"""Unit names and conversions, as column expressions and as lookup tables for joins."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helioquant.functions.fixed import fixed_rows

# Canonical units by dimension.
DIMENSIONS = {
    "power": ("W", "kW", "MW", "GW"),
    "energy": ("Wh", "kWh", "MWh", "GWh"),
    "irradiance": ("W/m²", "kW/m²"),
    "temperature": ("degC", "degF", "K"),
}
DIMENSION_OF = {unit: dimension for dimension, units in DIMENSIONS.items() for unit in units}

# Accepted spellings (lower case) of each canonical unit.
SPELLINGS = {
    "W": ("w", "watt", "watts"),
    "kW": ("kw", "kilowatt", "kilowatts"),
    "MW": ("mw", "megawatt", "megawatts"),
    "GW": ("gw", "gigawatt", "gigawatts"),
    "Wh": ("wh", "whr", "watt-hour", "watthour", "watt_hour", "watt-hours"),
    "kWh": ("kwh", "kwhr", "kilowatt-hour", "kilowatthour", "kilowatt_hour", "kilowatt-hours"),
    "MWh": ("mwh", "mwhr", "megawatt-hour", "megawatthour", "megawatt_hour", "megawatt-hours"),
    "GWh": ("gwh", "gwhr", "gigawatt-hour", "gigawatthour", "gigawatt_hour"),
    "W/m²": (
        "w/m2", "w/m^2", "w/m²", "w / m2", "w / m^2", "w / m²",
        "watt/m2", "watt/m^2", "watt/m²", "watts/m2", "watts/m^2", "watts/m²",
    ),
    "kW/m²": (
        "kw/m2", "kw/m^2", "kw/m²", "kw / m2", "kw / m^2", "kw / m²",
        "kilowatt/m2", "kilowatt/m^2", "kilowatt/m²",
    ),
    "degC": ("c", "degc", "deg_c", "°c", "celsius", "centigrade"),
    "degF": ("f", "degf", "deg_f", "°f", "fahrenheit"),
    "K": ("k", "kelvin"),
}

# What a unit text is looked up by: exact canonical names, and the lower-case spellings.
LOOKUP = {unit: unit for unit in DIMENSION_OF} | {
    spelling: unit for unit, spellings in SPELLINGS.items() for spelling in spellings
}

# Word forms that shorten to "deg", in the order in which they are tried.
DEGREE_WORDS = ("degrees ", "degree ", "deg ")


class UnknownConversionError(ValueError):
    """A unit that is not known, or a pair of units without a conversion."""

    def __init__(self, from_unit: str, to_unit: str = "", reason: str = "") -> None:
        self.from_unit = from_unit
        self.to_unit = to_unit
        self.reason = reason
        super().__init__(f"no conversion from {from_unit!r} to {to_unit!r}: {reason}")


@dataclass(frozen=True)
class Affine:
    """``((v + pre) * mul) / div + post``; neutral steps add nothing to an expression."""

    pre: float = 0.0
    mul: float = 1.0
    div: float = 1.0
    post: float = 0.0

    def __call__(self, value):
        out = value
        if self.pre != 0.0:
            out = out + self.pre
        if self.mul != 1.0:
            out = out * self.mul
        if self.div != 1.0:
            out = out / self.div
        if self.post != 0.0:
            out = out + self.post
        return out


Conversion = Callable[[Column], Column]

# The direct pairs. Conversion is not transitive; a pair that is not listed fails.
_PAIRS: dict[tuple[str, str], Conversion] = {
    ("kW", "W"): Affine(mul=1e3),
    ("W", "kW"): Affine(div=1e3),
    ("MW", "W"): Affine(mul=1e6),
    ("W", "MW"): Affine(div=1e6),
    ("MW", "kW"): Affine(mul=1e3),
    ("kW", "MW"): Affine(div=1e3),
    ("GW", "W"): Affine(mul=1e9),
    ("W", "GW"): Affine(div=1e9),
    ("MWh", "kWh"): Affine(mul=1e3),
    ("kWh", "MWh"): Affine(div=1e3),
    ("Wh", "kWh"): Affine(div=1e3),
    ("kWh", "Wh"): Affine(mul=1e3),
    ("MWh", "Wh"): Affine(mul=1e6),
    ("Wh", "MWh"): Affine(div=1e6),
    ("GWh", "kWh"): Affine(mul=1e6),
    ("kWh", "GWh"): Affine(div=1e6),
    ("kW/m²", "W/m²"): Affine(mul=1e3),
    ("W/m²", "kW/m²"): Affine(div=1e3),
    ("degF", "degC"): Affine(pre=-32.0, mul=5.0 / 9.0),
    ("degC", "degF"): Affine(mul=9.0 / 5.0, post=32.0),
    ("K", "degC"): Affine(pre=-273.15),
    ("degC", "K"): Affine(post=273.15),
    ("degF", "K"): Affine(pre=-32.0, mul=5.0 / 9.0, post=273.15),
    ("K", "degF"): Affine(pre=-273.15, mul=9.0 / 5.0, post=32.0),
}


def _unrecognized(text: str) -> str:
    return f"'{text}' is not a unit spelling on file"


def _not_text(kind: str) -> str:
    return f"units are given as text, got {kind}"


EMPTY_UNIT = "no unit given (empty)"


def normalize_unit(text: str) -> str:
    """Canonical unit of a spelling, on the driver; raises where there is none."""
    if not isinstance(text, str):
        raise UnknownConversionError(str(text), reason=_not_text(type(text).__name__))
    exact = text.strip()
    folded = " ".join(exact.lower().split())
    for word in DEGREE_WORDS:
        folded = folded.replace(word, "deg")
    unit = exact if exact in DIMENSION_OF else LOOKUP.get(folded)
    if unit is None:
        raise UnknownConversionError(text, reason=_unrecognized(text) if exact else EMPTY_UNIT)
    return unit


def unit_key(unit: Column | str) -> Column:
    """The text a unit column is looked up by (canonical names keep their case)."""
    unit = F.col(unit) if isinstance(unit, str) else unit
    trimmed = F.regexp_replace(unit, r"(?U)^\s+|\s+$", "")
    key = F.regexp_replace(F.lower(trimmed), r"(?U)\s+", " ")
    for word in DEGREE_WORDS:
        key = F.replace(key, F.lit(word), F.lit("deg"))
    # A text that is a lookup key already, as most are, skips the pattern work.
    return (
        F.when(unit.isin(*LOOKUP), unit)
        .when(trimmed.isin(*DIMENSION_OF), trimmed)
        .otherwise(key)
    )


def normalize_unit_expr(unit: Column | str) -> Column:
    """Canonical unit of a unit column; null where the spelling is not known."""
    entries = [F.lit(part) for pair in LOOKUP.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), unit_key(unit))


def unit_table(spark: SparkSession) -> DataFrame:
    """(unit_key, unit, dimension): fixed, under a hundred rows."""
    rows = [(key, unit, DIMENSION_OF[unit]) for key, unit in LOOKUP.items()]
    return fixed_rows(spark, rows, "unit_key string, unit string, dimension string")


def register_conversion(from_unit: str, to_unit: str, conversion: Conversion) -> None:
    """Add or replace the conversion of a pair of known units.

    An :class:`Affine` also serves row-by-row conversion through the lookup table; any other
    ``Column -> Column`` function is applied as an expression of its own.
    """
    _PAIRS[(normalize_unit(from_unit), normalize_unit(to_unit))] = conversion


def get_conversion(from_unit: str, to_unit: str) -> Conversion:
    """The conversion of a pair; identity for equal units; raises where there is none."""
    source, target = normalize_unit(from_unit), normalize_unit(to_unit)
    if source == target:
        # A registered same-unit function does not displace the identity.
        return lambda value: value
    if DIMENSION_OF[source] != DIMENSION_OF[target]:
        raise UnknownConversionError(
            from_unit,
            to_unit,
            f"dimensions differ: {DIMENSION_OF[source]} is not {DIMENSION_OF[target]}",
        )
    if (source, target) not in _PAIRS:
        raise UnknownConversionError(
            from_unit, to_unit, f"no conversion on file from {source} to {target}"
        )
    return _PAIRS[(source, target)]


def convert(value: Column | float | int, from_unit: str, to_unit: str):
    """Convert a column or a number; units are resolved while the plan is built."""
    conversion = get_conversion(from_unit, to_unit)
    if isinstance(value, Column):
        return conversion(value)
    if isinstance(value, (int, float)):
        return float(conversion(value))
    raise TypeError(f"cannot convert a {type(value).__name__}; give a Column or a number")


def convert_columns(df: DataFrame, units: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Convert columns in place, keeping their names, order and nulls."""
    return df.withColumns({name: convert(F.col(name), *pair) for name, pair in units.items()})


def conversion_table(spark: SparkSession) -> DataFrame:
    """The affine pairs as rows, identities included."""
    schema = "from_unit string, to_unit string, pre double, mul double, div double, post double"
    identity = Affine()
    rows = [(u, u, identity.pre, identity.mul, identity.div, identity.post) for u in DIMENSION_OF]
    rows += [
        (source, target, c.pre, c.mul, c.div, c.post)
        for (source, target), c in _PAIRS.items()
        if isinstance(c, Affine) and source != target
    ]
    return fixed_rows(spark, rows, schema)


def convert_readings(
    df: DataFrame,
    value: str = "value",
    from_unit: str = "unit",
    to_unit: str = "target_unit",
    out: str = "converted",
    error: str = "conversion_error",
    converters: Mapping[tuple[str, str], Conversion] | None = None,
) -> DataFrame:
    """Convert a long table whose units are columns; failures get a reason, never an exception.

    ``converters`` adds conversions of pairs of known units, or replaces them, for this call alone.

    The lookup tables are local relations of known size, which Spark broadcasts: the readings are
    neither shuffled nor sorted.
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    for name in (from_unit, to_unit):
        if not isinstance(types[name], T.StringType):
            raise UnknownConversionError(name, reason=_not_text(types[name].simpleString()))
    units = unit_table(spark)
    # Custom functions of a pair are applied as expressions; the rest comes from the table.
    custom = {pair: c for pair, c in _PAIRS.items() if not isinstance(c, Affine)}
    for pair, conversion in (converters or {}).items():
        custom[normalize_unit(pair[0]), normalize_unit(pair[1])] = conversion
    affine = conversion_table(spark).withColumn("_known", F.lit(True))

    def side(prefix: str) -> DataFrame:
        return units.select(*[F.col(c).alias(f"{prefix}{c}") for c in units.columns])

    joined = (
        df.withColumn("_v", F.expr(f"try_cast(`{value}` as double)"))
        .withColumn("_f_unit_key", unit_key(from_unit))
        .withColumn("_t_unit_key", unit_key(to_unit))
        .join(side("_f_"), "_f_unit_key", "left")
        .join(side("_t_"), "_t_unit_key", "left")
        .join(
            affine.withColumnsRenamed({"from_unit": "_f_unit", "to_unit": "_t_unit"}),
            ["_f_unit", "_t_unit"],
            "left",
        )
    )
    v = F.col("_v")
    result = F.when(
        F.col("_known"), ((v + F.col("pre")) * F.col("mul")) / F.col("div") + F.col("post")
    )
    known = F.coalesce(F.col("_known"), F.lit(False))
    for (source, target), conversion in custom.items():
        hit = (F.col("_f_unit") == source) & (F.col("_t_unit") == target) & F.lit(source != target)
        result = F.when(hit, conversion(v)).otherwise(result)
        known = known | F.coalesce(hit, F.lit(False))

    def blank(name: str) -> Column:
        return F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"(?U)\s+", "") == ""

    def unrecognized(name: str) -> Column:
        return F.concat(F.lit("'"), F.col(name), F.lit("' is not a unit spelling on file"))

    reason = (
        F.when(F.col(value).isNotNull() & v.isNull(), F.lit("not a number"))
        .when(blank(from_unit) | blank(to_unit), F.lit(EMPTY_UNIT))
        .when(F.col("_f_unit").isNull(), unrecognized(from_unit))
        .when(F.col("_t_unit").isNull(), unrecognized(to_unit))
        .when(
            F.col("_f_dimension") != F.col("_t_dimension"),
            F.lit("dimensions differ"),
        )
        .when(~known, F.lit("no conversion on file"))
    )
    return joined.select(
        *[F.col(c) for c in df.columns],
        F.when(reason.isNull(), result).alias(out),
        reason.alias(error),
    )
