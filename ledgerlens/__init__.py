"""PySpark-native compliance analytics."""
