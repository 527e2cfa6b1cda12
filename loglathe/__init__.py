"""A PySpark-native structure learner: raw text lines become typed, nested DataFrames."""

__version__ = "0.1.0"
