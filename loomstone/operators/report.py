"""Reports of a bounded table of metrics: JSON, Markdown, HTML."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame


def rows_of(metrics: DataFrame, most: int = 10_000) -> list[dict]:
    return [r.asDict(recursive=True) for r in metrics.limit(most).collect()]


def to_json(metrics: DataFrame) -> str:
    return json.dumps(rows_of(metrics), indent=2, default=str)


def _cell(x) -> str:
    return f"{x:.4f}" if isinstance(x, float) else "" if x is None else str(x)


def to_markdown(metrics: DataFrame, title: str = "Report") -> str:
    names = metrics.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "| " + " | ".join("---" for _ in names) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(_cell(r[n]).replace("|", "\\|") for n in names) + " |" for r in rows_of(metrics))]) + "\n"


def to_html(metrics: DataFrame, title: str = "Report") -> str:
    names = metrics.columns
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
    body = "".join(row([_cell(r[n]) for n in names], "td") for r in rows_of(metrics))
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{row(names, 'th')}{body}</table></body></html>"
