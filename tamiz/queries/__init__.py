"""Importing the package registers every query."""

from tamiz.queries import columns, feeds, files, loads, quality, schemas  # noqa: F401
from tamiz.queries.registry import QUERIES, SQL  # noqa: F401
