"""Relational operators over the catalog; every function takes and returns DataFrames."""
