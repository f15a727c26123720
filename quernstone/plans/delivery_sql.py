"""SQL that the delivery queries must agree with, written apart from their plans."""

from __future__ import annotations

from quernstone.fields import MONEY_FIELDS, STATEMENT_DATES, STATEMENT_REQUIRED, VALUATION_COLUMNS

_PLAIN = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def _known(x: str) -> str:
    return f"trim({x}) NOT IN ('', 'NA', 'N/A', 'null')"


def _number(x: str) -> str:
    return f"CASE WHEN regexp_full_match(trim({x}), '{_PLAIN}') AND isfinite(try_cast(trim({x}) AS DOUBLE)) THEN try_cast(trim({x}) AS DOUBLE) END"


def _day(x: str) -> str:
    return f"coalesce(regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({x} AS DATE) IS NOT NULL, false)"


def _cell(name: str) -> str:
    raw = f"cells[{VALUATION_COLUMNS.index(name) + 1}]"
    return f"CASE WHEN {raw}[1] = '\"' THEN replace({raw}[2:-2], '\"\"', '\"') ELSE {raw} END AS {name}"


_RECORD_CELLS = ("snapshot_date", "available_at", "revision_id", "market_cap", "unit_scale", "fx_to_reporting", "fx_date")
_RECORDS = f"""
    cut AS (SELECT record_id, coalesce(regexp_full_match(raw_line, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*'), true) AS quoted,
                   coalesce(regexp_extract_all(raw_line || ',', '(?s)("(?:[^"]|"")*"|[^",]*),', 1), []) AS cells FROM raw_records),
    record_cells AS (SELECT *, {', '.join(map(_cell, _RECORD_CELLS))} FROM cut),
    records AS (SELECT 'raw_records' AS tbl, record_id AS row_id, CASE WHEN NOT quoted THEN 'quoting' WHEN len(cells) <> 12 THEN 'column_count'
        WHEN NOT ({_day('snapshot_date')} AND {_day('available_at')} AND (trim(fx_date) = '' OR {_day('fx_date')}) AND (trim(revision_id) = '' OR regexp_full_match(revision_id, '[0-9]+'))
                  AND {' AND '.join(f"(NOT {_known(f)} OR coalesce(({_number(f)}) > 0, false))" for f in ('market_cap', 'unit_scale', 'fx_to_reporting'))}) THEN 'value' END AS reason FROM record_cells)"""

# Amounts: everything but the number, its unit and its currency must be gone.
_NUM = "([0-9][0-9,]*([.][0-9]*)?|[.][0-9]+)(e[+-]?[0-9]+)?"
_CUR = "(cny|rmb|人民币|人民幣|cn¥|¥|hkd|hk[$]|港元|港币|港幣|usd|us[$]|美元)"
_UNIT = "(thousand|million|billion|trillion|百万|百萬|千万|千萬|十亿|十億|万亿|萬億|千|万|萬|亿|億|mn|bn|tn|m|b|k)"
_AMOUNTS = f"""
    raw_amounts AS (SELECT *, lower(market_cap) AS t, regexp_extract(lower(market_cap), '{_NUM}') AS num FROM valuations WHERE {_known('market_cap')}),
    beside AS (SELECT *, regexp_replace(regexp_replace(t, '{_NUM}', '#', 'g'), '\\s+', '', 'g') AS rest,
                      CASE WHEN regexp_full_match(num, '([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]*)([.][0-9]*)?(e[+-]?[0-9]+)?') THEN try_cast(replace(num, ',', '') AS DOUBLE) END AS n FROM raw_amounts),
    read_amounts AS (SELECT *, regexp_extract(regexp_replace(rest, '{_CUR}', '|', 'g'), '{_UNIT}', 1) AS u1, regexp_extract(rest, '{_CUR}') AS c1,
                            regexp_full_match(rest, '({_CUR}?{_UNIT}?元?|[（(]{_CUR}?{_UNIT}?元?[）)]|{_CUR}[（(]{_UNIT}元?[）)])[+]?#({_UNIT}?元?{_CUR}?|{_CUR}{_UNIT}元?|[（(]{_UNIT}?元?{_CUR}?[）)])')
                            AND len(regexp_extract_all(rest, '{_CUR}')) <= 1 AND len(regexp_extract_all(regexp_replace(rest, '{_CUR}', '|', 'g'), '{_UNIT}')) <= 1 AS fits FROM beside),
    amounts AS (SELECT *, CASE WHEN fits AND n > 0 AND isfinite(n) THEN n END AS number FROM read_amounts)"""
_UNIT_VALUE = """CASE WHEN u1 IN ('thousand', '千', 'k') THEN 1e3 WHEN u1 IN ('万', '萬') THEN 1e4 WHEN u1 IN ('million', 'mn', 'm', '百万', '百萬') THEN 1e6 WHEN u1 IN ('千万', '千萬') THEN 1e7
    WHEN u1 IN ('亿', '億') THEN 1e8 WHEN u1 IN ('billion', 'bn', 'b', '十亿', '十億') THEN 1e9 WHEN u1 IN ('trillion', 'tn', '万亿', '萬億') THEN 1e12 END"""


def _currency(x: str) -> str:
    return f"CASE WHEN {x} IN ('cny', 'rmb', '人民币', '人民幣', 'cn¥', '¥') THEN 'CNY' WHEN {x} IN ('hkd', 'hk$', '港元', '港币', '港幣') THEN 'HKD' WHEN {x} IN ('usd', 'us$', '美元') THEN 'USD' END"


def _type(f: str) -> str:
    return f"json_type(p, '$.{f}')"


def _plain(f: str) -> str:
    return f"(CASE WHEN {_type(f)} IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') THEN {_number(f'(p->>{chr(39)}$.{f}{chr(39)})')} END)"


def _absent(f: str) -> str:
    return f"(coalesce({_type(f)}, 'NULL') = 'NULL')"


def _text(f: str) -> str:
    return f"CASE WHEN {_type(f)} = 'VARCHAR' THEN p->>'$.{f}' END"


_STRIPPED = r"""regexp_replace(payload_json, '"([^"\\]|\\.)*"', '""', 'g')"""
_STATEMENTS = f"""
    parsed AS (SELECT statement_id, CASE WHEN json_valid(payload_json) AND NOT regexp_matches({_STRIPPED}, ',\\s*[}}\\]]|(?i)(nan|inf)') THEN payload_json END AS p FROM statements),
    statement_reasons AS (SELECT 'statements' AS tbl, statement_id AS row_id, CASE WHEN p IS NULL THEN 'syntax'
        WHEN json_type(p) <> 'OBJECT' OR len(json_keys(p)) > len(list_distinct(json_keys(p))) OR {' OR '.join(map(_absent, STATEMENT_REQUIRED))} THEN 'shape'
        WHEN {' OR '.join(f"NOT {_day(f'({_text(f)})')}" for f in STATEMENT_DATES)}
          OR {' OR '.join(f"NOT ({_absent(f)} OR coalesce(NOT {_known(f'({_text(f)})')}, false) OR {_plain(f)} IS NOT NULL)" for f in MONEY_FIELDS)}
          OR NOT coalesce({_plain('unit_scale')} > 0, false)
          OR NOT ({_absent('revision_id')} OR coalesce(trim({_text('revision_id')}) = '', false) OR coalesce({_plain('revision_id')} >= 0 AND {_plain('revision_id')} = floor({_plain('revision_id')}), false))
          OR NOT ({_absent('equity_issued')} OR coalesce(trim({_text('equity_issued')}) = '', false) OR coalesce({_plain('equity_issued')} IN (0, 1), false)) THEN 'value' END AS reason FROM parsed)"""
_ALL = f"WITH {_RECORDS}, {_AMOUNTS}, {_STATEMENTS}, reasons AS (SELECT * FROM records UNION ALL SELECT 'valuations', valuation_id, 'value' FROM amounts WHERE number IS NULL UNION ALL SELECT * FROM statement_reasons)"

_VALUED = f"""{_AMOUNTS},
        placed AS (SELECT a.*, upper(trim(a.ticker)) AS tk, c.reporting_currency AS rep, coalesce({_currency("lower(trim(a.currency))")}, {_currency('c1')}, c.reporting_currency) AS cur FROM amounts a LEFT JOIN companies c ON upper(trim(a.ticker)) = upper(trim(c.ticker)) WHERE number IS NOT NULL),
        valued AS (SELECT valuation_id, run_id, tk, snapshot_date, provider, coalesce({_UNIT_VALUE}, unit_scale) AS unit, cur, coalesce(rep, cur) AS reporting, number * coalesce({_UNIT_VALUE}, unit_scale, 1.0)
                          * CASE WHEN cur IS NOT DISTINCT FROM coalesce(rep, cur) THEN 1.0 ELSE coalesce(fx_to_reporting, r.rate) END AS amount
                   FROM placed LEFT JOIN fx_rates r ON r.rate_month = date_trunc('month', snapshot_date) AND r.from_currency = cur AND r.to_currency = rep)"""

SQL = {
    "p4_stated": f"WITH {_VALUED} SELECT valuation_id, tk AS ticker, unit, cur AS currency, reporting AS reporting_currency, amount FROM valued WHERE unit IS NOT NULL",
    "p2_found": f"{_ALL} SELECT tbl, row_id, reason FROM reasons WHERE reason IS NOT NULL",
    "p2_loaded": f"""{_ALL}, every AS (SELECT 'raw_records' AS tbl, record_id AS row_id FROM raw_records UNION ALL SELECT 'valuations', valuation_id FROM valuations UNION ALL SELECT 'statements', statement_id FROM statements)
        SELECT tbl, row_id FROM every WHERE (tbl, row_id) NOT IN (SELECT (tbl, row_id) FROM reasons WHERE reason IS NOT NULL)""",
    "p4_found": f"""WITH {_VALUED}
        SELECT least(a.valuation_id, b.valuation_id) AS valuation_a, greatest(a.valuation_id, b.valuation_id) AS valuation_b
        FROM valued a JOIN valued b ON a.run_id = b.run_id AND a.tk = b.tk AND a.snapshot_date = b.snapshot_date AND a.valuation_id < b.valuation_id
        WHERE a.provider <> b.provider AND abs(a.amount - b.amount) <= 0.005 * greatest(a.amount, b.amount)""",
    "p5_found": """
        WITH known AS (
            SELECT s.statement_id, v.valuation_id,
                   row_number() OVER (PARTITION BY s.statement_id ORDER BY v.snapshot_date DESC, v.available_at DESC,
                                      v.revision_id DESC NULLS LAST, v.valuation_id) AS place
            FROM statements s JOIN valuations v
              ON s.run_id = v.run_id AND upper(trim(s.ticker)) = upper(trim(v.ticker))
             AND v.snapshot_date <= s.available_at AND v.available_at <= s.available_at)
        SELECT statement_id, valuation_id FROM known WHERE place = 1""",
}
