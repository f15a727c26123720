"""All text queries, and the SQL that they must agree with."""

from __future__ import annotations

from quernstone.llm.queries import QUERIES
from quernstone.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]
