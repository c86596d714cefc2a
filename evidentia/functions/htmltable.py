"""HTML tables to rows of text: cells, spans filled out, header paths, section rows. As a table function of pandas batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame


class _Cells(HTMLParser):
    """Collects (head, [(text, rowspan, colspan, is_header)]) rows of the first table."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.cell, self.head, self.done = [], None, False, False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "thead":
            self.head = True
        elif tag == "tr":
            self.rows.append((self.head, []))
        elif tag in ("td", "th"):
            a = dict(attrs)
            span = lambda k: max(1, int(a[k])) if (a.get(k) or "").isdigit() else 1
            self.cell = [[], span("rowspan"), span("colspan"), tag == "th"]
        elif tag == "br" and self.cell:
            self.cell[0].append(" ")

    def handle_data(self, data):
        if self.cell and not self.done:
            self.cell[0].append(data)

    def handle_endtag(self, tag):
        if tag == "thead":
            self.head = False
        elif tag in ("td", "th") and self.cell:
            if not self.rows:
                self.rows.append((self.head, []))
            parts, down, across, header = self.cell
            self.rows[-1][1].append((" ".join("".join(parts).split()), down, across, header))
            self.cell = None
        elif tag == "table":
            self.done = True


def grid(html: str | None) -> list[tuple[bool, list[str]]]:
    """Rows of (is_head, texts) with row and column spans filled by their cell's text."""
    parser = _Cells()
    parser.feed(html or "")
    parser.close()
    out, hanging = [], {}
    for head, cells in parser.rows:
        row, col, queue = [], 0, list(cells)
        while queue or any(c >= col for c in hanging):
            if col in hanging:
                text, left = hanging.pop(col)
                if left > 1:
                    hanging[col] = (text, left - 1)
                row.append(text)
                col += 1
            elif queue:
                text, down, across, _ = queue.pop(0)
                for k in range(across):
                    if down > 1:
                        hanging[col + k] = (text, down)
                    row.append(text)
                    if col + k in hanging:
                        hanging[col + k] = (text, down - 1)
                col += across
            else:
                row.append("")
                col += 1
        if row:
            out.append((head, row))
    return out


def rows_as_text(html: str | None) -> list[dict]:
    """Body rows as ``Row i | Section context: s | header: value ; ...``.

    Without a thead the first row is the header. A row of several cells of which one alone is filled is a section;
    equal neighbours in a header path are one part.
    """
    rows = grid(html)
    heads = [r for h, r in rows if h] or [r for _, r in rows[:1]]
    body = [r for h, r in rows if not h] if any(h for h, _ in rows) else [r for _, r in rows[1:]]
    width = max((len(r) for _, r in rows), default=0)
    paths = []
    for c in range(width):
        parts = [r[c] for r in heads if c < len(r) and r[c]]
        paths.append(" / ".join(p for k, p in enumerate(parts) if not k or p != parts[k - 1]))
    out, section, n = [], None, 0
    for r in body:
        filled = [v for v in r if v]
        if len(r) > 1 and len(filled) == 1:
            section = filled[0]
            continue
        if not filled:
            continue
        n += 1
        pairs = " ; ".join(f"{paths[c] or f'col {c + 1}'}: {v}" for c, v in enumerate(r) if v)
        out.append({"row": n, "section": section, "cells": r, "text": " | ".join([f"Row {n}", *([f"Section context: {section}"] if section else []), pairs])})
    return out


def table_rows(tables: DataFrame) -> DataFrame:
    """``tables(table_id, html)`` to (table_id, row, section, text)."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([(t, x["row"], x["section"], x["text"]) for t, h in zip(b["table_id"], b["html"], strict=True) for x in rows_as_text(h)], columns=["table_id", "row", "section", "text"])

    return tables.select("table_id", "html").mapInPandas(run, "table_id string, row int, section string, text string")
