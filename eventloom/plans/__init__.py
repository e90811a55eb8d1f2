"""Registered queries, by theme."""


def load() -> None:
    """Import the modules, which register their queries."""
    from eventloom.plans import graph_queries, higher_order_queries, model_queries, more_queries, network_queries, sequence_queries  # noqa: F401
