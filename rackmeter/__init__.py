"""Cluster telemetry analytics as Spark DataFrames."""
