"""All queries by name, as functions of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from ..sources.views import Book
from . import analytics, enrich, ingest, platform, reconcile, streams, verify

_ALL = {k: v for part in (analytics, reconcile, enrich, platform, verify, ingest, streams) for k, v in part.QUERIES.items()}


def _bound(function):
    def query(spark, sf_dir):
        return function(Book(spark, sf_dir))

    query.__name__ = function.__name__
    query.__doc__ = function.__doc__
    return query


QUERIES = {name: _bound(function) for name, (function, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
