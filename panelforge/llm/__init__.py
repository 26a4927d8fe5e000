"""Operators of a training-data pipeline, with their queries; nothing else in the package imports this one."""

from panelforge.llm import conversation_trie, decontamination, divergence, html_extraction, line_dedup, lm_scoring, minhash_dedup, packing, private_data, sharding, token_counts, topk_search, toxicity  # noqa: F401
from panelforge.llm.registry import ORACLES, QUERIES  # noqa: F401
