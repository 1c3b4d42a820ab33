"""Queries over the supplied tables, and the same in SQL."""

from . import core, extra, more  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
