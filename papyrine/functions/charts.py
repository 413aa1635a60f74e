"""Chart data from a model (JSON) to cells, labels and Markdown."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column

from . import tables
from .udf import vectorised


def _parsed(data: str | None) -> dict:
    try:
        made = json.loads(data or "")
    except ValueError:
        return {}
    return made if isinstance(made, dict) else {}


def _said(value) -> str:
    return str(value or "").strip()


def cells(chart: dict) -> list[str]:
    """TXT-33: all cells, row by row."""
    out: list[str] = []
    for row in chart.get("rows") or []:
        out += map(str, row.values() if isinstance(row, dict) else row if isinstance(row, list) else [row])
    return out


def labels(chart: dict) -> list[str]:
    """TXT-33: title, plain column names, and cells with letters."""
    names = [str(c) for c in chart.get("columns") or [] if isinstance(c, (str, int, float))]
    found = [str(chart.get("title") or ""), *names, *(c for c in cells(chart) if re.search(r"[^\W\d_]", c))]
    return [x for x in found if x.strip()]


def markdown(data: str | None, raw: str | None) -> str:
    """TXT-28: title and type, description, and the data as a table padded to its widest row; the raw text if there is no JSON."""
    chart = _parsed(data)
    names, rows = chart.get("columns") or [], chart.get("rows") or []
    parts = [" — ".join(filter(None, (_said(chart.get("title")), _said(chart.get("chart_type"))))), _said(chart.get("description"))]
    if rows and isinstance(rows, list) and isinstance(names, list):
        grid = [[str(n) for n in names]] if names else []
        for row in rows:
            if isinstance(row, dict):
                grid.append([str(row.get(n, "")) for n in names] if names else [str(v) for v in row.values()])
            else:
                grid.append([str(v) for v in row] if isinstance(row, list) else [str(row)])
        width = max(map(len, grid))
        parts.append(tables.to_markdown(tables.from_grid([r + [""] * (width - len(r)) for r in grid], bool(names))))
    return "\n\n".join(filter(None, parts)) or (raw or "").strip()


@vectorised("struct<cells:array<string>,labels:array<string>>", once=True)
def _described(data: pd.Series) -> pd.DataFrame:
    rows = [(cells(c), labels(c)) for c in map(_parsed, data)]
    return pd.DataFrame(rows, columns=["cells", "labels"], index=data.index)


@vectorised("string")
def _markdown(data: pd.Series, raw: pd.Series) -> pd.Series:
    return pd.Series([markdown(a, b) for a, b in zip(data, raw, strict=True)], data.index, dtype=object)


def described(data: Column) -> Column:
    return _described(data)


def chart_markdown(data: Column, raw: Column) -> Column:
    return _markdown(data, raw)
