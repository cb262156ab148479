"""Joins, aggregates, profiling, screening, preparation and models over DataFrames."""
