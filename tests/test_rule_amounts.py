"""Queries whose amounts the delivery's rule settles do not run the unit model."""

import itertools

import pytest
from pyspark.sql import functions as F

from quernstone.operators import units
from quernstone.plans import delivery


def test_no_stage_without_effect(spark, sf, monkeypatch):
    """p4_found and p4_stated give the same rows whatever the model says, so they must not ask it; p4_by_model must."""
    stated = {r.valuation_id: (r.unit, r.amount) for r in delivery._amounts(spark, sf, "model").where("route = 'stated'").collect()}
    ruled = delivery._amounts(spark, sf).collect()

    def asked(*_, **__):
        raise AssertionError("the model was asked")

    monkeypatch.setattr(units, "train_units", asked)
    monkeypatch.setattr(units, "assign_units", asked)
    found = delivery.p4_found(spark, sf)
    assert not any(x in found._jdf.queryExecution().optimizedPlan().toString() for x in ("MapInArrow", "PythonMapInArrow"))
    same = lambda a, b: (a.run_id, a.ticker, a.snapshot_date) == (b.run_id, b.ticker, b.snapshot_date) and a.provider != b.provider
    by: dict[tuple, list] = {}
    for r in ruled:
        if r.amount is not None and None not in (r.run_id, r.ticker, r.snapshot_date, r.provider):
            by.setdefault((r.run_id, r.ticker, r.snapshot_date), []).append(r)
    want = sorted((min(a.valuation_id, b.valuation_id), max(a.valuation_id, b.valuation_id)) for rows in by.values() for a, b in itertools.combinations(rows, 2)
                  if same(a, b) and abs(a.amount - b.amount) <= 0.005 * max(a.amount, b.amount))
    assert sorted(tuple(r) for r in found.collect()) == want and want
    assert {r.valuation_id: (r.unit, r.amount) for r in delivery.p4_stated(spark, sf).collect()} == stated
    with pytest.raises(AssertionError, match="asked"):
        delivery.p4_by_model(spark, sf)


def test_the_rule_sets_every_unit_and_the_model_the_route(spark, sf):
    x = delivery._amounts(spark, sf).where("route <> 'stated'")
    assert {r.unit for r in x.select("unit").distinct().collect()} == {1.0}
    assert x.where((F.col("route") == "model") & (F.col("unit_model") != 1.0)).count() == 0
