"""The registered queries of the engine's own operators, with their DuckDB oracles."""

from __future__ import annotations

from studyloom.catalog import concepts, scripts, text

QUERIES = {**text.QUERIES, **concepts.QUERIES, **scripts.QUERIES}
ORACLES = {**text.ORACLES, **concepts.ORACLES, **scripts.ORACLES}
