"""The query library: pure functions (graph, parameters) -> DataFrame."""
