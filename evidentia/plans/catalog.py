"""Registered queries of the evidence engine and their SQL."""

from __future__ import annotations

from evidentia.plans import on_documents, on_layout, on_tables, on_text

QUERIES: dict = {**on_text.QUERIES, **on_tables.QUERIES, **on_documents.QUERIES, **on_layout.QUERIES}
SQL: dict = {**on_text.SQL, **on_tables.SQL, **on_documents.SQL, **on_layout.SQL}
