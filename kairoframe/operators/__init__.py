"""Joins, aggregates, windows, recurrences, identity, simulation and statistics over point-in-time rows."""
