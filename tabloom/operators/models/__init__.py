"""Estimators: fitting runs Spark jobs, prediction stays a lazy projection or join."""
