"""quern: a PySpark-native code-search and corpus-processing engine."""

__version__ = "0.1.0"
