"""Quillgrove: hybrid retrieval and corpus analytics as Spark DataFrames."""
