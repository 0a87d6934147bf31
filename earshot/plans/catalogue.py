"""All registered queries of the corpus operators, and their SQL twins."""

from __future__ import annotations

from earshot.plans import aggregates, clustering, evaluation, gates, intervals, joins, labels, ranking, sources, splitting, streams
from earshot.plans.registry import ORACLE_SQL, QUERIES

MODULES = (gates, aggregates, ranking, splitting, intervals, joins, sources, clustering, labels, evaluation, streams)

__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
