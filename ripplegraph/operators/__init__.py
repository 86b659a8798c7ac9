"""Relational and graph operators; each takes DataFrames and returns a DataFrame."""
