"""Composed entry points (queries) and their DuckDB oracle SQL."""
