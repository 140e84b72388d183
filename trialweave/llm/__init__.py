"""Operators for preparing language-model training data, and their queries.

Every operator takes and returns DataFrames and keeps to the columns that its docstring names:
other columns of the input are ignored, so clashing names cannot disturb it.
"""
