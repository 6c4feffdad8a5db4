"""Relational and grouping operators; each takes and returns DataFrames."""
