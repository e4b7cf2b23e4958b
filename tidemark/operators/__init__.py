"""Flood-change operators: DataFrame in, DataFrame out."""
