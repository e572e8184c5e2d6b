"""Corpus operators for training data: quality, duplicates, leaks, personal data, tokens.

Nothing outside this folder imports it. Every operator takes and returns DataFrames;
``queries`` registers one query for each of them.
"""
