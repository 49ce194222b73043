"""A PySpark-native engine for structured form and survey data."""
