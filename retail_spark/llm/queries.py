"""The operators as queries over whole tables, and SQL twins where SQL has the words for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retail_spark.llm import (
    bpe,
    divergence,
    fingerprints,
    hpylm,
    licenses,
    linededup,
    neardup,
    packing,
    passages,
    quality,
    resampling,
    secrets,
    vafile,
)
from retail_spark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: report(table(spark, folder, name))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": _over("documents", neardup.near_duplicates),
    "op2_license_scan": _over("documents", licenses.license_report),
    "op3_secret_scan": _over("documents", secrets.secret_report),
    "op4_top_k_search": _over("embeddings", vafile.top_k),
    "op5_bpe_round_trip": _over("documents", bpe.bpe_report),
    "op6_lm_scores": _over("documents", hpylm.score_texts),
    "op7_line_dedup": _over("documents", linededup.line_report),
    "op8_quality_rules": _over("documents", quality.quality_report),
    "op9_shared_passages": _over("documents", passages.shared_passages),
    "op10_packing": _over("documents", packing.packing_report),
    "op11_source_divergence": _over("documents", divergence.divergences),
    "op12_importance_resampling": lambda spark, folder: resampling.importance(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    ),
    "op13_fingerprints": _over("documents", fingerprints.fingerprint_report),
}

ORACLE: dict[str, str] = {
    "op4_top_k_search": vafile.TOP_K_SQL,
    "op7_line_dedup": linededup.REPORT_SQL,
    "op11_source_divergence": divergence.AUDIT_SQL,
    "op12_importance_resampling": resampling.IMPORTANCE_SQL,
}
