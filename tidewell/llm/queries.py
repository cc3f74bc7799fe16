"""Queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bestfit, chat, decontamination, hamming, idstore, packing, quality, repair, secrets, similarity, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_topk": hamming.op1_hamming_topk,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_similarity_join": similarity.op5_similarity_join,
    "op6_chat": chat.op6_chat,
    "op7_warc": warc.op7_warc,
    "op8_quality": quality.op8_quality,
    "op9_id_store": idstore.op9_id_store,
    "op10_secrets": secrets.op10_secrets,
    "op11_best_fit": bestfit.op11_best_fit,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_structure_repair": repair.op13_structure_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_hamming_topk": hamming.SQL,
    "op2_decontamination": decontamination.SQL,
    "op6_chat": chat.SQL,
    "op12_filter_audit": audit.SQL,
    "op13_structure_repair": repair.SQL,
}
