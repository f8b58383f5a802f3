"""Named queries over the given tables, each with its DuckDB counterpart where SQL can say it."""

from tickloom.queries.registry import ORACLES, QUERIES
from tickloom.queries import book, ledger, predictions, tables, ticks  # noqa: F401  (registers)

__all__ = ["ORACLES", "QUERIES"]
