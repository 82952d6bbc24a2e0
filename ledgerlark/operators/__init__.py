"""Operators: reports, row rules and change jobs over domain DataFrames."""
