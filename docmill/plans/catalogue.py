"""All registered queries: name -> function of (spark, sf_dir), and the same in SQL."""

from __future__ import annotations

from docmill.plans import corpus, operations, relational, retrieval, surface, texts

PARTS = (relational, corpus, surface, operations, retrieval, texts)


def queries() -> dict:
    return {name: query for part in PARTS for name, query in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for part in PARTS for name, text in part.oracle_sql().items()}
