"""Registered queries with their oracles, and text plans."""
