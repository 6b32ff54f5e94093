"""Operators: plain functions from DataFrames to DataFrames, lazy unless a docstring says otherwise."""
