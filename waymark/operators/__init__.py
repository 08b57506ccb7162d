"""Operators: functions from DataFrames (and a trip filter) to a DataFrame."""
