"""Span analytics on Spark: detect, curate, resolve, redact and score labelled character spans."""
