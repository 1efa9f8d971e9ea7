"""PySpark-native analytics for moving-object telemetry and keyed time series."""
