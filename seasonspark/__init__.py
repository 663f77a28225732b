"""Spark-first analytics for gridded seasonal time series and orbital forcing."""
