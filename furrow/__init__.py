"""Harvest planning and daily weather analytics as Spark DataFrames."""
