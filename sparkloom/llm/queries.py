"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = ("op1_token_counts", "op2_suffix_dedup", "op3_decontaminate", "op4_simhash", "op5_byte_bpe", "op6_quality", "op7_topk_products", "op8_pii", "op9_huffman_ids", "op10_warc")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
