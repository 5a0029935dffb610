"""Reports as JSON and Markdown, rendered on the driver from aggregated (small) tables."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame


def rows_of(table: DataFrame, *order: str) -> list[dict[str, Any]]:
    """Rows of an aggregated table as dictionaries, in order."""
    return [r.asDict(recursive=True) for r in (table.orderBy(*order) if order else table).collect()]


def keyed(rows: list[dict[str, Any]], key: str) -> dict[str, dict[str, Any]]:
    """Rows by the value of ``key``, sorted, without that column."""
    return {str(r[key]): {k: v for k, v in r.items() if k != key} for r in sorted(rows, key=lambda r: str(r[key]))}


def rounded(part: float | None, whole: float | None, places: int = 4) -> float:
    """``part / whole`` rounded, 0.0 where ``whole`` is 0."""
    return round(part / whole, places) if whole else 0.0


def render_json(report: dict[str, Any]) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2) + "\n"


def render_table(rows: list[dict[str, Any]], columns: list[str] | None = None) -> str:
    """A Markdown table; numbers are right-aligned."""
    if not rows:
        return "(none)\n"
    names = columns or list(rows[0])
    numeric = {c: all(isinstance(r.get(c), (int, float)) for r in rows) for c in names}
    lines = ["| " + " | ".join(names) + " |", "|" + "|".join("---:" if numeric[c] else "---" for c in names) + "|"]
    lines += ["| " + " | ".join("-" if r.get(c) is None else str(r[c]) for c in names) + " |" for r in rows]
    return "\n".join(lines) + "\n"


def render_markdown(title: str, report: dict[str, Any]) -> str:
    """A report as Markdown: scalars as a list, tables (lists of rows, or rows by key) as sections."""
    head, body = [f"# {title}\n"], []
    for name, value in report.items():
        if isinstance(value, dict) and value and all(isinstance(v, dict) for v in value.values()):
            body.append(f"\n## {name}\n\n" + render_table([{name: k, **v} for k, v in value.items()]))
        elif isinstance(value, list) and value and all(isinstance(v, dict) for v in value):
            body.append(f"\n## {name}\n\n" + render_table(value))
        elif isinstance(value, dict):
            head += [f"- {name}.{k}: {v}" for k, v in value.items()]
        else:
            head.append(f"- {name}: {value}")
    return "\n".join(head) + "\n" + "".join(body)


def save(text: str, path: str | Path) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text, encoding="utf-8")
