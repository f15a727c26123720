import csv
import datetime
import io
import json
import math
import re

import pytest

from quernstone.operators import rejects

UNKNOWN = ("", "NA", "N/A", "null")


def failed(df):
    return {r.row_id: r.reason for r in df.collect()}


def real_day(s):
    try:
        return isinstance(s, str) and bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", s, re.ASCII)) and bool(datetime.date.fromisoformat(s))
    except ValueError:
        return False


def plain_number(s):
    s = s.strip()
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s, re.ASCII):
        return None
    v = float(s)
    return v if math.isfinite(v) else None


def reason_of_record(line):
    """Brute force, character by character."""
    if line is None:
        return "column_count"
    cells, i, n = [], 0, len(line)
    while True:
        if i < n and line[i] == '"':
            j, cell = i + 1, ""
            while True:
                if j >= n:
                    return "quoting"
                if line[j] == '"':
                    if j + 1 < n and line[j + 1] == '"':
                        cell, j = cell + '"', j + 2
                        continue
                    break
                cell, j = cell + line[j], j + 1
            i = j + 1
            if i < n and line[i] != ",":
                return "quoting"
        else:
            j = i
            while j < n and line[j] != ",":
                if line[j] == '"':
                    return "quoting"
                j += 1
            cell, i = line[i:j], j
        cells.append(cell)
        if i >= n:
            break
        i += 1
    if len(cells) != 12:
        return "column_count"
    c = dict(zip(rejects.VALUATION_COLUMNS, cells))
    ok = real_day(c["snapshot_date"]) and real_day(c["available_at"]) and (not c["fx_date"].strip() or real_day(c["fx_date"]))
    ok = ok and (not c["revision_id"].strip() or bool(re.fullmatch("[0-9]+", c["revision_id"])))
    for f in ("market_cap", "unit_scale", "fx_to_reporting"):
        v = None if c[f].strip() in UNKNOWN else plain_number(c[f])
        ok = ok and (c[f].strip() in UNKNOWN or (v is not None and v > 0))
    return None if ok else "value"


def test_records_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/../sf0.01/raw_records.parquet")
    want = {r.record_id: w for r in df.collect() if (w := reason_of_record(r.raw_line))}
    assert failed(rejects.failures(rejects.parsed_records(df, "record_id", "raw_line"), "raw_records")) == want
    assert len(want) > 20


@pytest.mark.parametrize(("line", "cells"), [
    ("a,b", ["a", "b"]), ("", [""]), (",", ["", ""]), ('"a,b",c', ["a,b", "c"]), ('"a""b"', ['a"b']), ('"a\nb",', ["a\nb", ""]), ('"a', None), ('"a"b,c', None), ('a"b', None), ('""', [""]),
    ('"a","b"', ["a", "b"]), ("x" * 100_000 + ",y", ["x" * 100_000, "y"]), ('"' + '""' * 50_000 + '",z', ['"' * 50_000, "z"]),
])
def test_split_record(line, cells):
    assert rejects.split_record(line) == cells
    if cells is not None and "\n" not in line and len(line) < 1000 and line:
        assert next(csv.reader(io.StringIO(line), strict=True)) == cells


GOOD = {k: "x" for k in rejects.STATEMENT_REQUIRED} | {"period_start": "2024-01-01", "period_end": "2024-12-31", "available_at": "2025-03-01", "unit_scale": "1000", "cash": 1.5}


def variant(**kw):
    return json.dumps({k: v for k, v in {**GOOD, **kw}.items() if v != "<drop>"})


CASES = {
    variant(): None, variant(extra={"a": 1, "a2": [1, {"b": None}]}): None, variant(cash="NA"): None, variant(cash=None): None, variant(cash="1e3"): None, variant(revision_id=""): None, variant(equity_issued="1"): None,
    variant(equity_issued=0): None, variant(revision_id=3): None, variant(revision_id="2.0"): None, None: "syntax", "": "syntax", "nope": "syntax", "{": "syntax", variant()[:-1] + ",}": "syntax", '{"a": NaN}': "syntax",
    '{"a": "line\nbreak"}': "syntax", variant() + " x": "syntax", "[]": "shape", "null": "shape", '"text"': "shape", "3": "shape", variant(name="<drop>"): "shape", variant(name=None): "shape",
    variant()[:-1] + ', "cash": 2}': "shape", variant(period_end="2024-02-30"): "value", variant(period_end="20241231"): "value", variant(available_at=20250301): "value", variant(cash="1,5"): "value",
    variant(cash=True): "value", variant(cash=[1]): "value", variant(cash="1e999"): "value", variant(cash="NaN"): "value", variant(unit_scale=0): "value", variant(unit_scale="NA"): "value", variant(unit_scale=False): "value",
    variant(revision_id=-1): "value", variant(revision_id=1.5): "value", variant(revision_id="two"): "value", variant(equity_issued="Y"): "value", variant(equity_issued=2): "value", variant(name=None, cash="x"): "shape",
    "﻿" + variant(): "syntax", variant(note="Z" * 200_000): None, '{"a":"\\ud800"}': "shape",
}


def test_objects(spark):
    texts = list(CASES)
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "statement_id bigint, payload_json string, rule string")
    got = failed(rejects.failures(rejects.parsed_objects(df, "statement_id", "payload_json"), "statements"))
    assert got == {i: CASES[t] for i, t in enumerate(texts) if CASES[t]}


AMOUNTS = {
    "12": 12, "1,234.5": 1234.5, "1,23": None, "12亿元人民币": 12, "（百万元）9,900.5": 9900.5, "RMB bn 3.2": 3.2, "HK$ 3 billion": 3, "港币 million 30,465.2": 30465.2, "1e999": None, "-5": None, "0": None, "-0": None, "5-6 million": None,
    "million": None, "5 million bn": None, "USD 5 HKD": None, "(5": None, "5元": 5, "1.5E+09": 1.5e9, "人民币 100（亿元）": 100, "12 34": None, "1.2.3": None, "": None, None: None, "NA": None, "inf": None, "3O9": None, "5\u0001,": None, "x" * 50_000: None,
}


def test_amounts(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(AMOUNTS)], "valuation_id bigint, market_cap string")
    got = {r.market_cap: r.number for r in rejects.with_amount(df, "market_cap").collect()}
    assert got == AMOUNTS
    bad = failed(rejects.failures(rejects.parsed_amounts(df, "valuation_id", "market_cap"), "valuations"))
    assert set(bad) == {i for i, (t, n) in enumerate(AMOUNTS.items()) if n is None and (t or "").strip() not in UNKNOWN}


def test_clean_rows_and_repeats(spark):
    df = spark.createDataFrame([(1, "5", "r1"), (1, "x", "r2"), (2, "7", "r3"), (2, "7", "r3")], "valuation_id bigint, market_cap string, row_id string")
    bad = rejects.failures(rejects.parsed_amounts(df, "valuation_id", "market_cap"), "valuations")
    assert failed(bad) == {1: "value"}
    assert [tuple(r) for r in rejects.loadable(df, "valuation_id", bad).collect()] == [(2, "7", "r3"), (2, "7", "r3")]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id bigint, t string")
    for parse, tbl in ((rejects.parsed_records, "raw_records"), (rejects.parsed_objects, "statements"), (rejects.parsed_amounts, "valuations")):
        assert rejects.failures(parse(e, "id", "t"), tbl).count() == 0


def test_deep_json_is_no_fault():
    deep = lambda n, inner="": '{"ticker": "x", "more": ' + "[" * n + inner + "]" * n + "}"
    for n in (3, 2_000, 60_000):
        assert rejects.split_object(deep(n))[0] is None and ("ticker", "text", "x") in rejects.split_object(deep(n))[1]
        assert rejects.split_object(deep(n, "1 2")) == (rejects.ROW_FIRST, []) and rejects.split_object(deep(n)[:-1]) == (rejects.ROW_FIRST, [])
    assert rejects.split_object("[" * 60_000 + "]" * 60_000) == (rejects.ROW_SECOND, [])
    twice = '{"a": 1, "a": ' + "[" * 60_000 + "]" * 60_000 + "}"
    assert rejects.split_object(twice) == (rejects.ROW_SECOND, [])


def test_without_depth_accepts_what_json_accepts():
    import json
    import random

    r = random.Random(4)

    def value(depth):
        k = r.randint(0, 7 if depth < 4 else 3)
        if k < 4:
            return r.choice(["1", "-0.5e+3", '"a\\u00e9\\n"', "true", "null", '""', "01", "1.", "nul", '"\\x"', "+1", "NaN"] if r.random() < 0.15 else ["1", "-0.5e+3", '"a\\u00e9"', "true", "null", '""'])
        if k < 6:
            return "[" + r.choice([",", " , ", ",,"] if r.random() < 0.1 else [",", " , "]).join(value(depth + 1) for _ in range(r.randint(0, 3))) + r.choice(["]"] * 15 + ["", ",]", "}"])
        return "{" + ",".join(r.choice(['"k"', '"l"']) + ":" + value(depth + 1) for _ in range(r.randint(0, 3))) + r.choice(["}"] * 15 + ["", ",}"])

    seen = set()
    for _ in range(4000):
        t = value(0)
        try:
            json.loads(t, parse_constant=rejects._no_constant)
            good = True
        except ValueError:
            good = False
        seen.add(good)
        short = rejects.without_depth(t)
        assert (short is not None) == good, t
        if good:
            json.loads(short)
            assert rejects.split_object(short) == rejects.split_object(t)
    assert seen == {True, False}
