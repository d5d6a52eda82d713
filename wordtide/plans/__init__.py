"""Queries over the tables at hand, built from the operators."""

from . import events, places, star, texts  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
