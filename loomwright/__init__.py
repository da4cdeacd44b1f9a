"""Retrieval, evaluation and corpus work as Spark jobs over DataFrames."""
