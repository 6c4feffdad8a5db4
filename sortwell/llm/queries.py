"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sortwell.llm import bpe, chat_repair, cnn, collocations, divergence, ego, exact_dedup, html_density, mixing, qda, simhash, token_histogram, winnowing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_histogram": token_histogram.op1_token_histogram,
        "op2_mixing": mixing.op2_mixing,
        "op3_html_text_density": html_density.op3_html_text_density,
        "op4_chat_role_repair": chat_repair.op4_chat_role_repair,
        "op5_quality_qda": qda.op5_quality_qda,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_epsilon_grid_order": ego.op7_epsilon_grid_order,
        "op8_bpe_chunk_reuse": bpe.op8_bpe_chunk_reuse,
        "op9_toxicity_cnn": cnn.op9_toxicity_cnn,
        "op10_simhash_multi_index": simhash.op10_simhash_multi_index,
        "op11_winnowing": winnowing.op11_winnowing,
        "op12_collocations": collocations.op12_collocations,
        "op13_divergence": divergence.op13_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.OP2_SQL,
        "op6_exact_dedup": exact_dedup.OP6_SQL,
        "op11_winnowing": winnowing.OP11_SQL,
        "op12_collocations": collocations.OP12_SQL,
        "op13_divergence": divergence.OP13_SQL,
    }
