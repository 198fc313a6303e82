"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage. ``registry`` holds its
queries, and ``corpus_pipeline.py`` at the repository top chains four operators.
"""
