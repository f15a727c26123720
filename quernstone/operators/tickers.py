"""Identity of issuers: tickers are compared trimmed and in upper case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.operators.rejects import strip


def clean_ticker(name: str) -> Column:
    """Ticker without surrounding blanks of any kind, in upper case; null stays null."""
    return F.upper(strip(F.col(name)))
