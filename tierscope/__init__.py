"""Routing and evaluation analytics over logged agent requests, as Spark DataFrames."""
