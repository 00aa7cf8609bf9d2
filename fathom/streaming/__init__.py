"""Streams: following a growing file, and windows over event time."""
