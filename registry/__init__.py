"""Named queries over the test tables and the SQL that checks them."""

from registry.base import ORACLES, QUERIES
from registry import sources, profiling, cleaning, testing, modelling, charting, runs  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
