"""Quirelight: document analytics on Spark DataFrames."""
