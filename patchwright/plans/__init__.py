"""Plans: the stand-in data set, the queries over it and their SQL."""

from . import evaluation, ingest, multilabel, relational, storage  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
