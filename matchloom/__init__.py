"""PySpark-native analytics for two-sided matching data (people, positions, interactions)."""
