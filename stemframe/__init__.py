"""Columnar signal analytics on PySpark: multi-track, multi-stem sampled signals as DataFrames."""
