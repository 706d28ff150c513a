"""Crawl-data processing on Spark DataFrames."""
