"""Evaluation metrics and chart tables as DataFrame aggregates."""
