"""Registered queries over the given tables, each with its plain SQL where SQL can say it."""

from seriesmill.queries import (  # noqa: F401
    aggregation,
    cleaning,
    evaluation,
    features,
    joining,
    literature,
    ordering,
    reading,
    runs,
    scalars,
    shaping,
    streams,
)
from seriesmill.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
