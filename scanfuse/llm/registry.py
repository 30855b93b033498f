"""Queries and oracles of the subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scanfuse.llm import bpe, chat, decontaminate, exact_dedup, hard_negatives, html, licences, line_dedup, quality, repair, sharding, simhash, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_bpe": bpe.op2_bpe,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_simhash": simhash.op5_simhash,
        "op6_licences": licences.op6_licences,
        "op7_html": html.op7_html,
        "op8_quality": quality.op8_quality,
        "op9_chat": chat.op9_chat,
        "op10_sharding": sharding.op10_sharding,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_repair": repair.op12_repair,
        "op13_topk": topk.op13_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op6_licences": licences.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_topk": topk.ORACLE}
