"""Scoring rows as they arrive."""
