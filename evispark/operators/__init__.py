"""Relational and document operators: DataFrame in, DataFrame out."""
