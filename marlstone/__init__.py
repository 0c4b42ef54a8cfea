"""Marlstone: topic analytics and text data processing on Spark DataFrames."""
