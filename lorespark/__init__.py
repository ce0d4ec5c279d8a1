"""A PySpark-native engine for document graphs and corpora."""

__version__ = "1.0.0"
