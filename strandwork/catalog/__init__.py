"""The registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from . import code_graph, context, graph_data, texts

_MODULES = (graph_data, code_graph, texts, context)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: f for m in _MODULES for k, f in m.ORACLE.items()}
