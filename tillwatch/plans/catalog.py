"""All registered queries and the SQL they must equal."""

from __future__ import annotations

from . import stream_queries  # noqa: F401 - registers its queries
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
