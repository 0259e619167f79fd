"""Named queries over the driver's tables, and the SQL that states the same results."""

from . import methods  # noqa: F401  (adds its queries)
from .queries import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
