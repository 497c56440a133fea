"""basalt: a PySpark-native lakehouse analytics engine."""
