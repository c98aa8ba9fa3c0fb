"""Millrace: search, vector, text, object and replica-comparison queries as Spark DataFrame plans."""
