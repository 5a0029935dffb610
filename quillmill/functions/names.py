"""Names for helper columns that no input column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(rows: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that ``rows`` has no such column (in any letter case)."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
