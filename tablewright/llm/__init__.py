"""Operators for preparing training text at scale; ``queries`` and ``sql`` list the registered ones."""

from __future__ import annotations


def queries() -> dict:
    from tablewright.llm import catalog

    return dict(catalog.QUERIES)


def sql() -> dict:
    from tablewright.llm import catalog

    return dict(catalog.SQL)
