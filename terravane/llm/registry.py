"""The queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terravane.llm import alignment, bit_search, context_tree, exact_dedup, line_dedup, mixing, near_dedup, packing, pseudonyms, quality, ranked_search, token_store, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": pseudonyms.op1_pseudonyms,
    "op2_token_store": token_store.op2_token_store,
    "op3_packing": packing.op3_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_context_tree": context_tree.op6_context_tree,
    "op7_mixing": mixing.op7_mixing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op8_bit_search": bit_search.op8_bit_search,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_alignment": alignment.op12_alignment,
    "op13_quality": quality.op13_quality,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_bit_search": bit_search.OP8_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_ranked_search": ranked_search.OP11_SQL,
}
