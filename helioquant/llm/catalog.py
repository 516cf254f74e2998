"""Registered queries of this subpackage: name to (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helioquant.llm import decontamination, fingerprints, language, licenses, mixing, neardup, neighbours, packing, repeats, spelling, toxicity, urlfilter, whitening

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_license_scans": (licenses.op1_license_scans, None),
    "op2_fingerprints": (fingerprints.op2_fingerprints, None),
    "op3_language_id": (language.op3_language_id, None),
    "op4_best_fit_packing": (packing.op4_best_fit_packing, None),
    "op5_temperature_mixing": (mixing.op5_temperature_mixing, None),
    "op6_suffix_array_dedup": (repeats.op6_suffix_array_dedup, None),
    "op7_nearest_neighbours": (neighbours.op7_nearest_neighbours, None),
    "op8_toxicity": (toxicity.op8_toxicity, None),
    "op9_url_filters": (urlfilter.op9_url_filters, urlfilter.ORACLE_SQL),
    "op10_minhash_near_dedup": (neardup.op10_minhash_near_dedup, None),
    "op11_spelling_variants": (spelling.op11_spelling_variants, None),
    "op12_embedding_whitening": (whitening.op12_embedding_whitening, None),
    "op13_benchmark_decontamination": (decontamination.op13_benchmark_decontamination, decontamination.ORACLE_SQL),
}
