"""Relational, interval, graph and numeric operators over DataFrames."""
