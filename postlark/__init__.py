"""Tracking, reading and ranking of job postings on Spark DataFrames."""
