"""tidelog: a PySpark-native engine that folds ordered change logs into tables."""

__version__ = "0.1.0"
