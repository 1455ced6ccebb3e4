"""Conversational-memory analytics and retrieval on Spark DataFrames."""
