"""Registered queries with their equivalent SQL."""

from . import cleaning, encoding, evaluation, models, sources, workflow  # noqa: F401
from .base import ORACLES, QUERIES  # noqa: F401
