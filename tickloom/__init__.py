"""Tickloom: multi-frequency time-series analytics as Spark DataFrames of ticks."""
