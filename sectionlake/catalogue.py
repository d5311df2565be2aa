"""The queries over the engine's own operators, and their equivalent SQL."""

from __future__ import annotations

from sectionlake.queries import incremental, lexical, parsing, ranking, reading, scanning, stored

_MODULES = (lexical, scanning, reading, ranking, incremental, parsing, stored)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
FLAGSHIP = lexical.search_tiered
