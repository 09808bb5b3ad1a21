"""Structured Streaming forms. Inputs are streaming DataFrames; outputs are to be written by the caller or by run()."""
