"""Operators over node tables."""

from .selection import Selection, select

__all__ = ["Selection", "select"]
