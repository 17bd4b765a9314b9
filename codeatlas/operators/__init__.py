"""Graph operators that go beyond one-hop expansion: joins by precedence, closures, aggregates, text tables."""
