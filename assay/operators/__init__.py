"""Operators: functions from DataFrames and parameters to DataFrames, none of which collects."""
