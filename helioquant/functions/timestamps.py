"""Time parsing, calendar and slot functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helioquant.functions.numeric import as_col

SECONDS_PER_DAY = 86_400

# Directive letters of strftime-style formats and the pattern letters Spark uses for them.
STRFTIME_TO_PATTERN = {
    "%d": "dd",
    "%m": "MM",
    "%Y": "yyyy",
    "%y": "yy",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
}

DAY_FIRST = "%d-%m-%Y %H:%M"
ISO_SECONDS = "%Y-%m-%d %H:%M:%S"


def spark_pattern(fmt: str) -> str:
    """Spark datetime pattern of a ``%``-format; a format without ``%`` is taken as a pattern."""
    if "%" not in fmt:
        return fmt
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "%":
            directive = fmt[i : i + 2]
            if directive not in STRFTIME_TO_PATTERN:
                raise ValueError(f"unsupported time directive {directive!r} in {fmt!r}")
            out.append(STRFTIME_TO_PATTERN[directive])
            i += 2
        else:
            out.append(f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i])
            i += 1
    return "".join(out)


def parse_ts(text: Column | str, fmt: str, strict: bool = False) -> Column:
    """Timestamp of a text column; text in another format gives null, or an error when strict."""
    pattern = F.lit(spark_pattern(fmt))
    text = as_col(text)
    if strict:
        return F.to_timestamp(text, spark_pattern(fmt))
    return F.try_to_timestamp(text, pattern)


def local_date(ts: Column | str) -> Column:
    return F.to_date(as_col(ts))


def to_utc(ts: Column | str, plant_tz: Column | str) -> Column:
    """UTC instant of a plant-local wall-clock time. ``plant_tz`` is a column or a zone name."""
    zone = plant_tz if isinstance(plant_tz, Column) else F.lit(plant_tz)
    return F.to_utc_timestamp(as_col(ts), zone)


def calendar_days(first: Column | str, last: Column | str) -> Column:
    """Days touched by the span: whole-day distance plus one."""
    return F.datediff(as_col(last), as_col(first)) + F.lit(1)


def date_text(day: Column | str) -> Column:
    return F.date_format(as_col(day), "yyyy-MM-dd")


def slot(ts: Column | str, interval_s: int = 900) -> Column:
    """Start of the reporting interval that holds the reading; a missing time stays missing."""
    over = F.pmod(epoch_micros(ts), F.lit(int(interval_s) * 1_000_000)).cast("decimal(18,0)")
    zero = F.lit(0)
    return as_col(ts) - F.make_dt_interval(zero, zero, zero, (over / F.lit(1_000_000)).cast("decimal(18,6)"))


def hours_per_slot(interval_s: int = 900) -> float:
    return interval_s / 3600.0


def epoch_micros(ts: Column | str) -> Column:
    """A 64-bit position on the time axis, for timestamps with or without a zone."""
    return F.unix_micros(as_col(ts).cast("timestamp"))
