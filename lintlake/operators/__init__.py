"""Operators on tables of lines, files, findings and logs: DataFrames in, DataFrame out, with repo as a key everywhere."""
