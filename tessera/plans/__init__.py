"""The queries; importing this registers all of them."""

from tessera.plans import graph_queries, monitor_queries, more_queries, prompt_queries, text_queries, walk_queries  # noqa: F401
