"""Named queries over the benchmark tables, each with the same question in SQL."""

from tidewatch.catalog.base import ORACLES, QUERIES
from tidewatch.catalog import event_log, users, windowed, tables, orders, streams  # noqa: F401  isort: skip

__all__ = ["ORACLES", "QUERIES"]
