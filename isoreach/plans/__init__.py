"""Queries over the tables, each with its SQL where SQL can express it."""

from isoreach.plans import capability, files, joins, scalars, selection, statistics
from isoreach.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "capability", "files", "joins", "scalars", "selection", "statistics"]
