"""Operators for large training corpora, their queries and SQL counterparts."""

from __future__ import annotations

from homologrid.llm import bpe, chat, exact_dedup, html, language, mixing, pii, repair, simhash, spelling, token_counts, token_files, topk

MODULES = [exact_dedup, simhash, mixing, bpe, language, token_files, topk, pii, chat, token_counts, html, repair, spelling]

QUERIES = {name: build for module in MODULES for name, build in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
