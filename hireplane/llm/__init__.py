"""Operators of a training-data pipeline: cleaning, matching, sampling and formatting of documents."""
