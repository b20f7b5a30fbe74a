"""Registered queries over the given tables."""

#: Modules with QUERIES and ORACLES, in the order they are registered.
CATALOGUES = ["hierarchy", "retrieval", "graph", "relations", "sources", "context", "graph_lookups", "lookups"]
