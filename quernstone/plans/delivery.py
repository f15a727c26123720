"""Queries on deliveries as they arrive: rejects, unit conversion, as-of attachment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quernstone.operators import asof, rejects, units
from quernstone.operators.tickers import clean_ticker
from quernstone.plans.delivery_sql import SQL
from quernstone.session import table


def _failed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {
        "raw_records": rejects.failures(rejects.parsed_records(table(spark, d, "raw_records"), "record_id", "raw_line"), "raw_records"),
        "valuations": rejects.failures(rejects.parsed_amounts(table(spark, d, "valuations"), "valuation_id", "market_cap"), "valuations"),
        "statements": rejects.failures(rejects.parsed_objects(table(spark, d, "statements"), "statement_id", "payload_json"), "statements"),
    }


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, _failed(spark, d).values())


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """(tbl, row_id) of the rows that load."""
    failed, ids = _failed(spark, d), {"raw_records": "record_id", "valuations": "valuation_id", "statements": "statement_id"}
    parts = [
        rejects.loadable(table(spark, d, t).select(i), i, failed[t]).selectExpr(f"'{t}' as tbl", f"cast({i} as bigint) as row_id") for t, i in ids.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _delivered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "valuations"), table(spark, d, "companies"), table(spark, d, "fx_rates")


def _amounts(spark: SparkSession, d: str, settle: str = "rule") -> DataFrame:
    return units.convert(*_delivered(spark, d), settle=settle)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """By the delivery's rule for a missing scale every amount is settled, so that no model is asked."""
    return units.agreeing_pairs(units.by_rule(units.read_amounts(*_delivered(spark, d))))


def p4_amounts(spark: SparkSession, d: str) -> DataFrame:
    return _amounts(spark, d)


def p4_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of which a missing unit is settled by the model alone: confident ones converted, the others null and for review."""
    return _amounts(spark, d, "model")


def p4_stated(spark: SparkSession, d: str) -> DataFrame:
    """Amounts of the rows that state their unit; no model has a part in them."""
    x = units.by_rule(units.read_amounts(*_delivered(spark, d)).where("unit_stated is not null"))
    return x.select("valuation_id", "ticker", "unit", "currency", "reporting_currency", "amount")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    keyed = lambda t: table(spark, d, t).withColumn("__ticker", clean_ticker("ticker"))
    return asof.attach_known(
        keyed("statements"), keyed("valuations"), event_id="statement_id", event_key=["run_id", "__ticker"], event_day="available_at",
        version_id="valuation_id", version_key=["run_id", "__ticker"], own_day="snapshot_date", pub_day="available_at", revision="revision_id",
    )


__all__ = ["QUERIES", "SQL"]

QUERIES = {"p2_found": p2_found, "p2_loaded": p2_loaded, "p4_found": p4_found, "p4_amounts": p4_amounts, "p4_by_model": p4_by_model, "p4_stated": p4_stated, "p5_found": p5_found}
