"""Sensor time-series and document analytics on PySpark."""
