"""The queries of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from . import bpe, caps, chat, katz, mtree, neardup, packing, quality, secrets, substrings

_MODULES = (katz, chat, secrets, mtree, packing, quality, caps, bpe, neardup, substrings)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
