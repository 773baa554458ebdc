"""Vanewright: a PySpark-native analytics engine for industrial time-series monitoring."""
