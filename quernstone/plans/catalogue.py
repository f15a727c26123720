"""All queries of the core, and the SQL that each must agree with."""

from __future__ import annotations

from quernstone.plans import delivery, filings, histories, rankings, screens, tables, texts, years

_PARTS = [delivery, filings, screens, years, histories, texts, rankings, tables]
QUERIES = {name: q for p in _PARTS for name, q in p.QUERIES.items()}
SQL = {name: s for p in _PARTS for name, s in p.SQL.items()}
