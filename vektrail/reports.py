"""Small results as Markdown, HTML or JSON."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

MOST_ROWS = 1_000  # reports are for summaries; more rows are an error, not a cut


def _rows(df: DataFrame) -> tuple[list[str], list[list]]:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report holds at most {MOST_ROWS} rows")
    return df.columns, [list(r) for r in rows]


def _text(x: object) -> str:
    return "–" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x)


def markdown(df: DataFrame, title: str) -> str:
    names, rows = _rows(df)
    cell = lambda x: _text(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + " --- |" * len(names)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def page(df: DataFrame, title: str) -> str:
    names, rows = _rows(df)
    line = lambda tag, xs: "<tr>" + "".join(f"<{tag}>{html.escape(_text(x))}</{tag}>" for x in xs) + "</tr>"
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{line('th', names)}{''.join(line('td', r) for r in rows)}</table>"


def as_json(df: DataFrame) -> str:
    names, rows = _rows(df)
    return json.dumps([dict(zip(names, r, strict=True)) for r in rows], default=str, sort_keys=True)
