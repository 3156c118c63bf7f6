"""playledger: a PySpark-native analytics engine for ordered event data."""

__version__ = "0.1.0"
