"""Profiler-trace analytics on Spark DataFrames."""
