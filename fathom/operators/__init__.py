"""Relational operators as thin compositions of DataFrame operations."""
