"""codeatlas: a PySpark-native property-graph analytics engine."""

__version__ = "0.1.0"
