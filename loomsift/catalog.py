"""All queries of the engine: importing the operator modules registers them."""

from __future__ import annotations

from .operators import addresses, assembly, blockmax, captured, chunking, drafts, guides, ignores, index, intents, manifests, metrics, planning, relational, reports, retrieval, routing, rules, scanner, search, settings, shell, store, tables_and_code, toolcalls, vectors, web, websearch  # noqa: F401
from .registry import ORACLES, QUERIES
from .streaming import events, stateful  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
