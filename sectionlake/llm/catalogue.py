"""The queries of this subpackage, and their equivalent SQL."""

from __future__ import annotations

from sectionlake.llm import bpe_codec, chat_trees, fingerprints, line_templates, near_duplicates, packing, sharding, tiled_cosine, token_counts, toxicity

_MODULES = (bpe_codec, chat_trees, fingerprints, line_templates, near_duplicates, packing, sharding, tiled_cosine, token_counts, toxicity)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
