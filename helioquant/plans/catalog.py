"""Every registered query with its oracle statement."""

from __future__ import annotations

from helioquant.plans import calls, intake, quality, registry, spans, telemetry

CATALOG = {
    **quality.QUERIES, **telemetry.QUERIES, **registry.QUERIES, **calls.QUERIES, **intake.QUERIES, **spans.QUERIES,
}
