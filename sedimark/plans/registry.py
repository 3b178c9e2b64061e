"""All named queries of the core, and their SQL."""

from __future__ import annotations

from sedimark.plans import documents, files, general, graphs, retrieval, storage

_MODULES = [general, documents, files, retrieval, graphs, storage]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in _MODULES for k, s in m.ORACLE.items()}
