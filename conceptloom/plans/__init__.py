"""Queries and adapters."""

from . import answers, nesting, queries, reports, training  # noqa: F401 - the others add to the queries
