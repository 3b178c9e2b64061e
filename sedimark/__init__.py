"""Spark-native document intelligence: sources, operators, plans and streams over DataFrames."""

__version__ = "0.1.0"
