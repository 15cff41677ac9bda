"""The queries that the driver runs. Importing the package registers them all."""

from . import graph_queries, record_queries, report_queries, text_queries  # noqa: F401
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
