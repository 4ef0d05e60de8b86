"""Operators for training-data pipelines on documents, pages and benchmarks; nothing else in the library imports them."""
