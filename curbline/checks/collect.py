"""Registration of a query with its SQL twin."""

from __future__ import annotations


def collection():
    """A decorator ``query(sql=None)`` and the two dicts it fills."""
    queries: dict = {}
    texts: dict = {}

    def query(text: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if text is not None:
                texts[fn.__name__] = text
            return fn

        return add

    return query, queries, texts
