"""Queries over the driver's tables, each with the DuckDB SQL it must equal."""

from tarnfield.queries import details, episodes, evaluation, experiments, judges, reports, retrieval, runs, text  # noqa: F401
from tarnfield.queries.registry import ORACLES, QUERIES

FLAGSHIP = QUERIES["keyword_recall"]

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
