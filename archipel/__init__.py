"""Archives as DataFrames: a PySpark-native archive and corpus engine."""

__version__ = "0.1.0"
