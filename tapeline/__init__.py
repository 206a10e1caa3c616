"""tapeline: market and event time-series analytics on PySpark."""
