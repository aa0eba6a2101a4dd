"""PySpark-native passive network-traffic analytics."""
