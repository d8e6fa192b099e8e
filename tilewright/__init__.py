"""Raster annotation and tile-inference analytics expressed as Spark jobs.

Operators take DataFrames and return DataFrames; ``functions`` holds column
expressions.  Nothing here collects rows to the driver: the only values that
travel there are small, fixed-size summaries (quantile edges, change counters).
"""
