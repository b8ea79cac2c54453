"""Relational operators and statistics over DataFrames."""
