"""Named queries over the driver's tables, with SQL twins."""

from __future__ import annotations

from . import graph_queries, source_queries, text_queries

QUERIES: dict = {**text_queries.QUERIES, **graph_queries.QUERIES, **source_queries.QUERIES}
ORACLES: dict = {**text_queries.ORACLES, **graph_queries.ORACLES, **source_queries.ORACLES}
