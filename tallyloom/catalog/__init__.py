"""Registered queries of the library, each with the SQL that must give the same rows where SQL can."""

from .registry import QUERIES, SQL  # noqa: F401
from . import audit, curation, policy, stats, streams, suggest, text  # noqa: E402, F401
