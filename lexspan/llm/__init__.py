"""Operators that prepare a text corpus for language-model training.

Nothing outside this package imports it; every operator takes and returns DataFrames.
"""
