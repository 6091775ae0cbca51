"""Corpus engine on Spark: documents to chunks, indexes, retrieval, graphs and statistics as DataFrames."""
