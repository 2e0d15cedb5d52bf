"""Relational operators over civic tables; each takes and returns DataFrames."""
