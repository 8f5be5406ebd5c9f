"""relgrain: a PySpark-native relational feature engine."""

__version__ = "0.1.0"
