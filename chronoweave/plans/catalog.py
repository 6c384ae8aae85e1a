"""Every registered query of the engine and, where SQL can express it, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "group_entities_by_connection"


def query(sql: str | None = None, graph: bool = True):
    """Register a function under its name; ``sql`` stands after the graph's views unless ``graph`` is false."""
    from ..sources import testgraph

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = testgraph.SQL + sql if graph else sql
        return f

    return put


from . import analytics_queries, build_queries, flow_queries, graph_queries, map_queries, page_queries, search_queries, timeline_queries  # noqa: E402, F401
