"""Catalogue, text, scoring, timeline and selection operators on Spark DataFrames."""
