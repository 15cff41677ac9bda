"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..schema import RECORDS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Pieces of DuckDB's SQL.
FOLD = "translate(lower({}), 'áéíóúüñ', 'aeiouun')"
USABLE = "(CASE WHEN status = 'ok' THEN text_normalized <> '' WHEN status = 'ok_partial' THEN length(text_normalized) >= 100 OR text_length >= 100 ELSE FALSE END)"
SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
TOKENS = r"regexp_extract_all(lower(text_normalized), '\b([a-z][a-z0-9_-]{2,})\b', 1)"


def query(oracle: str | None = None, records: bool = True, recursive: bool = False):
    """Registers a query under its function's name; ``oracle`` may use the view ``r`` of records."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{RECORDS_SQL}{oracle if oracle.lstrip().startswith(',') else ' ' + oracle}" if records else oracle
        return f

    return register
