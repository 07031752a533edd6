"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reachway.llm import decontaminate, hard_negatives, licenses, line_dedup, packing, pieces, pii, quality, resampling, rules, simhash, toxicity, warc
from reachway.llm.common import table


def _over(f: Callable[..., DataFrame], *names: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(*[table(spark, sf_dir, n) for n in names])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": _over(pii.pii_report, "documents"),
        "op2_simhash": _over(simhash.simhash_report, "documents"),
        "op3_quality": _over(quality.quality_report, "documents", "labels"),
        "op4_warc": _over(warc.round_trip, "pages"),
        "op5_rules": _over(rules.rules_report, "documents"),
        "op6_toxicity": _over(toxicity.toxicity_report, "documents", "labels"),
        "op7_line_dedup": _over(line_dedup.line_report, "documents"),
        "op8_decontaminate": _over(decontaminate.leak_report, "documents", "benchmark"),
        "op9_packing": _over(packing.pack_documents, "documents"),
        "op10_licenses": _over(licenses.license_report, "documents"),
        "op11_resampling": _over(resampling.resampling_report, "documents", "benchmark"),
        "op12_pieces": _over(pieces.pieces_report, "documents"),
        "op13_negatives": _over(hard_negatives.negatives_report, "embeddings"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE, "op5_rules": rules.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op10_licenses": licenses.ORACLE, "op11_resampling": resampling.ORACLE, "op13_negatives": hard_negatives.ORACLE}
