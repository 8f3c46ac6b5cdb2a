"""Typed-token analytics of text, and training-data operations, on Spark DataFrames."""
