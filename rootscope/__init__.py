"""Trace and telemetry root-cause analytics on PySpark DataFrames."""
