"""Gauge: measurement, catalogue, text-search and corpus analytics as Spark DataFrames."""
