"""The queries of this package by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowtide.llm import clusters, codes, decontamination, fingerprints, languages, packing, quality, repeats, secrets, sharding, simhash, tokens, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [packing.op1_pack, secrets.op2_secrets, simhash.op3_simhash, quality.op4_quality, urls.op5_urls, languages.op6_language, sharding.op7_sharding, fingerprints.op8_fingerprint, decontamination.op9_decontamination, repeats.op10_repeats, clusters.op11_clusters, tokens.op12_tokens, codes.op13_codes]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": decontamination.OP9_SQL, "op10_repeats": repeats.OP10_SQL, "op11_clusters": clusters.OP11_SQL, "op13_codes": codes.OP13_SQL}
