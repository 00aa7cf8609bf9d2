"""Registered queries of the engine's own operators, with their oracle SQL."""
