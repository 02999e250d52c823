"""Reports of small metric tables as JSON and Markdown files, written whole or not at all."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame

LARGEST = 10_000


def _rows(metrics: DataFrame) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in metrics.limit(LARGEST + 1).collect()]
    if len(rows) > LARGEST:
        raise ValueError(f"a report holds at most {LARGEST} rows")
    return rows


def _replace(path: str, text: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temporary, path)


def write_json(metrics: DataFrame, path: str) -> None:
    _replace(path, json.dumps(_rows(metrics), indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n")


def write_lines(metrics: DataFrame, path: str) -> None:
    _replace(path, "".join(json.dumps(r, sort_keys=True, ensure_ascii=False, default=str) + "\n" for r in _rows(metrics)))


def write_markdown(metrics: DataFrame, path: str, title: str) -> None:
    head = metrics.columns
    lines = [f"# {title}", "", "| " + " | ".join(head) + " |", "|" + " --- |" * len(head)]
    lines += ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in head) + " |" for r in _rows(metrics)]
    _replace(path, "\n".join(lines) + "\n")
