"""Tesserae: a Spark-native store and query engine for geospatial feature files."""

__version__ = "0.1.0"
