"""Fragments shared by the oracle statements; each mirrors one column helper."""

from __future__ import annotations

TS_FORMAT = "%Y-%m-%d %H:%M:%S.%f"

# The number inside events.props.
K = r"CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER)"


def rounded(x: str, digits: int) -> str:
    factor = f"CAST({10**digits} AS DOUBLE)"
    return f"(floor(CAST({x} AS DOUBLE) * {factor} + 0.5) / {factor})"


def total(x: str, decimals: int = 2) -> str:
    factor = f"CAST({10**decimals} AS DOUBLE)"
    return (
        f"(CAST(sum(CAST(floor(CAST({x} AS DOUBLE) * {factor} + 0.5) AS BIGINT)) AS DOUBLE)"
        f" / {factor})"
    )


def mean(x: str, decimals: int = 2) -> str:
    return f"({total(x, decimals)} / nullif(count({x}), 0))"


def ts_text(x: str) -> str:
    return f"strftime({x}, '{TS_FORMAT}')"


def day_text(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d')"


def flag(x: str) -> str:
    """A boolean as text, with a null spelled out."""
    return f"coalesce(CAST({x} AS VARCHAR), 'unknown')"
