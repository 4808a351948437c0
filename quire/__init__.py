"""quire: a PySpark-native engine for searching and analysing line-oriented text."""

__version__ = "0.1.0"
