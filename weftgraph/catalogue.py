"""Every query of the engine, with the SQL that says the same."""

from __future__ import annotations

from weftgraph.queries import ORACLE, QUERIES, apidocs, audits, documents, graph, hydration, loads, models, parts

__all__ = ["ORACLE", "QUERIES", "apidocs", "audits", "documents", "graph", "hydration", "loads", "models", "parts"]
