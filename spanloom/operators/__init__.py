"""Operators on documents, spans, tokens and predictions: DataFrames in, DataFrames out."""
