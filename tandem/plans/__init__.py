"""Registered queries: compositions of the operators over the driver's tables."""

from . import catalog, commands, edits, items, pairs, records, search, vectors
from .items import knn_cosine
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "commands", "edits", "items", "knn_cosine", "pairs", "records", "search", "vectors"]
