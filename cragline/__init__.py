"""PySpark-native terrain-prominence and summit-reconciliation engine."""
