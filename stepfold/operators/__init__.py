"""Operators on traces: plain functions from DataFrames to DataFrames."""
