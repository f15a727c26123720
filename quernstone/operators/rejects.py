"""Rows that fail to parse, kept apart from the rows that load, with a reason.

Plan
1. a parser turns each row into cells (row id, column, kind, value). Only this
   step needs Python for CSV records and JSON objects, as neither Spark's CSV
   nor its JSON reader is strict enough; amounts are parsed by built-in
   expressions. A row whose text cannot be cut into cells has none, only a
   fault of the whole row.
2. the cells are exploded and joined with a rule table: which check holds for
   which column of which table, and how its failure ranks.
3. the checks are built-in expressions. Cells that pass are dropped before the
   only shuffle, which sees failures alone; per row the failure of the lowest
   rank gives the reason.
4. the rows that load are the anti-join of the input with the failures.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.fields import MONEY_FIELDS, STATEMENT_DATES, STATEMENT_REQUIRED, VALUATION_COLUMNS

# Fixed values of the input formats.
#: Texts that mean "unknown", besides blanks.
UNKNOWN = ("NA", "N/A", "null")

#: A plain or exponent number, without signs of grouping.
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"

CURRENCY_WORDS = {
    "CNY": ("CNY", "RMB", "人民币", "人民幣", "CN¥", "¥"),
    "HKD": ("HKD", "HK$", "港元", "港币", "港幣"),
    "USD": ("USD", "US$", "美元"),
}
UNIT_WORDS = {
    1e3: ("thousand", "千", "k"),
    1e4: ("万", "萬"),
    1e6: ("million", "mn", "m", "百万", "百萬"),
    1e7: ("千万", "千萬"),
    1e8: ("亿", "億"),
    1e9: ("billion", "bn", "b", "十亿", "十億"),
    1e12: ("trillion", "tn", "万亿", "萬億"),
}

# Ranks: the smallest failing rank of a row names its reason.
ROW_FIRST, ROW_SECOND, CELL = 1, 2, 3
REASONS = {
    "raw_records": {ROW_FIRST: "quoting", ROW_SECOND: "column_count", CELL: "value"},
    "statements": {ROW_FIRST: "syntax", ROW_SECOND: "shape", CELL: "value"},
    "valuations": {CELL: "value"},
}
#: (table, column, check, rank of its failure)
RULES = [
    *[("raw_records", c, rule, CELL) for c, rule in (
        ("snapshot_date", "day"), ("available_at", "day"), ("fx_date", "day_or_blank"), ("revision_id", "digits_or_blank"),
        ("market_cap", "positive_or_unknown"), ("unit_scale", "positive_or_unknown"), ("fx_to_reporting", "positive_or_unknown"))],
    *[("statements", c, "present", ROW_SECOND) for c in STATEMENT_REQUIRED],
    *[("statements", c, "text_day", CELL) for c in STATEMENT_DATES],
    *[("statements", c, "number_or_unknown", CELL) for c in MONEY_FIELDS],
    ("statements", "unit_scale", "positive", CELL), ("statements", "revision_id", "whole_or_absent", CELL), ("statements", "equity_issued", "issued_flag", CELL),
    ("valuations", "market_cap", "amount_or_unknown", CELL),
]


def rule_table(spark: SparkSession) -> DataFrame:
    """(tbl, column_name, rule, rank): one row per check, a fixed number of rows."""
    return spark.createDataFrame(RULES, "tbl string, column_name string, rule string, rank int")


# -- parsers -----------------------------------------------------------------

_QUOTED = re.compile(r'"([^"]*(?:""[^"]*)*)"')


def split_record(line: str) -> list[str] | None:
    """Cells of one CSV record; None if its quoting is broken."""
    if '"' not in line:
        return line.split(",")
    cells, at, n = [], 0, len(line)
    while True:
        if line.startswith('"', at):
            m = _QUOTED.match(line, at)
            if m is None or (m.end() < n and line[m.end()] != ","):
                return None
            cells.append(m.group(1).replace('""', '"'))
            at = m.end()
        else:
            end = line.find(",", at)
            end = n if end < 0 else end
            cell = line[at:end]
            if '"' in cell:
                return None
            cells.append(cell)
            at = end
        if at >= n:
            return cells
        at += 1


class _Number(str):
    """A JSON number, as written."""


class _Pairs(list):
    """The members of a JSON object, in order, repeats kept."""


def _no_constant(name: str):
    raise ValueError(name)


_strict = json.JSONDecoder(object_pairs_hook=_Pairs, parse_int=_Number, parse_float=_Number, parse_constant=_no_constant)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\]:,])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null))')


def without_depth(text: str, keep: int = 2) -> str | None:
    """A JSON text with an empty list for every list or object that lies deeper than `keep` levels; None if it is not strict JSON.

    A loop with a stack of its own, whatever the depth.
    """
    out: list[str] = []
    stack: list[str] = []  # open brackets
    at, n, expect = 0, len(text), "value"
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            break
        mark, string, scalar = m.groups()
        at, depth = m.end(), len(stack)
        token = mark or string or scalar
        if expect in ("value", "value or ]") and (string or scalar or mark in ("{", "[")):
            if mark:
                stack.append(mark)
                expect = "key or }" if mark == "{" else "value or ]"
                if depth == keep:
                    out.append("[")
                elif depth < keep:
                    out.append(token)
                continue
            expect = "next" if stack else "end"
        elif expect in ("key", "key or }") and string:
            expect = ":"
        elif expect == ":" and mark == ":":
            expect = "value"
        elif expect == "next" and mark == ",":
            expect = "key" if stack[-1] == "{" else "value"
        elif mark in ("}", "]") and stack and stack[-1] == {"}": "{", "]": "["}[mark] and expect in ("next", "key or }" if mark == "}" else "value or ]"):
            stack.pop()
            expect = "next" if stack else "end"
            if depth == keep + 1:
                out.append("]")
            elif depth <= keep:
                out.append(token)
            continue
        else:
            return None
        if depth <= keep:
            out.append(token)
    return "".join(out) if expect == "end" and not text[at:].strip(" \t\n\r") else None


def split_object(text: str | None) -> tuple[int | None, list[tuple[str, str, str | None]]]:
    """(rank of a fault of the whole row, cells) of one JSON text; a cell is (column, kind, value)."""
    try:
        value = _strict.decode(text)
    except (ValueError, TypeError):
        return ROW_FIRST, []
    except RecursionError:
        # nests deeper than the decoder's stack: what lies deep is checked, but no cell, so that an empty list stands for it
        shallow = without_depth(text)
        return (ROW_FIRST, []) if shallow is None else split_object(shallow)
    if not isinstance(value, _Pairs):
        return ROW_SECOND, []
    names = [k for k, _ in value]
    if len(set(names)) < len(names):
        return ROW_SECOND, []
    cells = []
    for k, v in value:
        if k in _STATEMENT_CELLS:
            kind = "null" if v is None else "number" if isinstance(v, _Number) else "text" if isinstance(v, str) else "other"
            cells.append((k, kind, v.encode("utf-8", "replace").decode() if isinstance(v, str) else None))
    present = {c[0] for c in cells}
    cells += [(k, "null", None) for k in STATEMENT_REQUIRED if k not in present]
    return None, cells


_STATEMENT_CELLS = {*STATEMENT_REQUIRED, *MONEY_FIELDS, "revision_id", "equity_issued"}

PARSED = "row_id bigint, fault_rank int, cells array<struct<column_name:string,kind:string,value:string>>"
_CELL = pa.list_(pa.struct([("column_name", pa.string()), ("kind", pa.string()), ("value", pa.string())]))
_PARSED_ARROW = pa.schema([("row_id", pa.int64()), ("fault_rank", pa.int32()), ("cells", _CELL)])
_CHECKED_RAW = {r: i for i, r in enumerate(VALUATION_COLUMNS) if r in (
    "snapshot_date", "available_at", "fx_date", "revision_id", "market_cap", "unit_scale", "fx_to_reporting")}


_FIELDS = [_CELL.value_type[i] for i in range(3)]
_NAMES = {c: i for i, c in enumerate(sorted({*VALUATION_COLUMNS, *_STATEMENT_CELLS}))}
_KINDS = {k: i for i, k in enumerate(("null", "number", "text", "other"))}


def _parsed(ids: pa.Array, faults: list[int | None], counts: list[int], names: list[int], kinds: list[int], values: pa.Array) -> pa.RecordBatch:
    """Rows of cells from flat lists: names and kinds as places in their fixed lists."""
    column = lambda codes, words: pa.array(list(words), pa.string()).take(pa.array(codes, pa.int32()))
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    cells = pa.StructArray.from_arrays([column(names, _NAMES), column(kinds, _KINDS), values], fields=_FIELDS)
    return pa.RecordBatch.from_arrays([ids, pa.array(faults, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), cells).cast(_CELL)], schema=_PARSED_ARROW)


def _parse_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, checked, width = list(_CHECKED_RAW.values()), [_NAMES[c] for c in _CHECKED_RAW], len(VALUATION_COLUMNS)
    pick = itemgetter(*places)
    for batch in batches:
        faults, counts, values = [], [], []
        for line in batch.column(1).to_pylist():
            cells = split_record(line) if line is not None else []
            if cells is not None and len(cells) == width:
                faults.append(None)
                counts.append(len(places))
                values.extend(pick(cells))
            else:
                faults.append(ROW_FIRST if cells is None else ROW_SECOND)
                counts.append(0)
        loaded = len(values) // len(places)
        yield _parsed(batch.column(0), faults, counts, checked * loaded, [_KINDS["text"]] * len(values), pa.array(values, pa.string()))


def _parse_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        faults, counts, names, kinds, values = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            fault, cells = split_object(text)
            faults.append(fault)
            counts.append(len(cells))
            for name, kind, value in cells:
                names.append(_NAMES[name])
                kinds.append(_KINDS[kind])
                values.append(value)
        yield _parsed(batch.column(0), faults, counts, names, kinds, pa.array(values, pa.string()))


def parsed_records(df: DataFrame, row_id: str, line: str) -> DataFrame:
    """Cells of CSV records, one row per record; a null record has no cells and so the wrong count."""
    return df.select(F.col(row_id).cast("long"), F.col(line).cast("string")).mapInArrow(_parse_records, PARSED)


def parsed_objects(df: DataFrame, row_id: str, payload: str) -> DataFrame:
    """Cells of JSON objects, one row per payload; a null or empty payload is a syntax fault."""
    return df.select(F.col(row_id).cast("long"), F.col(payload).cast("string")).mapInArrow(_parse_objects, PARSED)


def parsed_amounts(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """The one checked cell of each valuation row: a null, a number if it states one amount, or other text."""
    read = with_amount(df.select(F.col(row_id).cast("long").alias("row_id"), F.col(column).cast("string").alias("value")), "value")
    kind = F.when(is_unknown(F.col("value")), "null").when(F.col("number").isNotNull(), "number").otherwise("text")
    cell = F.struct(F.lit("market_cap").alias("column_name"), kind.alias("kind"), F.col("value"))
    return read.select("row_id", F.lit(None).cast("int").alias("fault_rank"), F.array(cell).alias("cells"))


#: Blanks that may surround a value.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """text without blanks of any kind at its ends."""
    return F.btrim(text, F.lit(BLANKS))


# -- checks, built in --------------------------------------------------------

def _words(groups: dict, *, longest_first: bool = True) -> str:
    words = [re.escape(w) for g in groups.values() for w in g]
    return "|".join(sorted(words, key=len, reverse=longest_first))


_AMOUNT_NUMBER = r"(?:[0-9][0-9,]*(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_AMOUNT_GROUPED = r"^(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]*)(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?$"


def _beside() -> str:
    """What may stand beside the number, written as #: the groups are listed below."""
    cur, unit = _words({k: [w.lower() for w in v] for k, v in CURRENCY_WORDS.items()}), _words(UNIT_WORDS)
    front = rf"({cur})?({unit})?元?(?:[（(]({cur})?({unit})?元?[）)])?"
    back = rf"(?:({unit})?元?({cur})?|({cur})({unit})元?)(?:[（(]({unit})?元?({cur})?[）)])?"
    return rf"^{front}\+?#{back}$"


#: Groups of _beside() that hold units and currencies.
_UNIT_GROUPS, _CURRENCY_GROUPS = (2, 4, 5, 8, 9), (1, 3, 6, 7, 10)


def with_amount(df: DataFrame, column: str) -> DataFrame:
    """df with number, unit_word and currency_word of the amount in a column; all null where it states no single amount.

    An amount is one number above 0, commas grouping thousands or an exponent
    allowed, with at most one unit and one currency on either side, also in
    brackets. A lone 元 names neither a unit nor, as it stands beside any
    currency, a currency. The number is cut out first, so that what stands
    beside it is a short text, and mostly none.
    """
    raw = F.col(column)
    # most amounts are a bare number and need no further reading
    plain = raw.rlike(r"^[0-9]+(?:\.[0-9]+)?$") & ~raw.endswith("\n")
    s1 = df.withColumn("__plain", F.coalesce(plain, F.lit(False))).withColumns({
        "__num": F.when(F.col("__plain"), raw).otherwise(F.regexp_extract(raw, _AMOUNT_NUMBER, 0)),
        # blanks are dropped after the number, so that they cannot join two
        "__rest": F.when(F.col("__plain"), F.lit("#")).otherwise(F.translate(F.regexp_replace(F.lower(raw), _AMOUNT_NUMBER, "#"), BLANKS, "")),
    })
    groups = lambda g: ",".join(f"${i}" for i in g)
    # units and currencies as two lists; the mark between them shows that the form fits
    read = F.when((F.col("__rest") != "#") & ~F.col("__rest").contains("\u0001"), F.regexp_replace("__rest", _beside(), f"{groups(_UNIT_GROUPS)}\u0001{groups(_CURRENCY_GROUPS)}"))
    s2 = s1.withColumns({"__read": read, "__value": F.when(F.col("__plain"), F.col("__num").try_cast("double")).when(F.col("__num").rlike(_AMOUNT_GROUPED), F.translate("__num", ",", "").try_cast("double"))})
    part = lambda i: F.btrim(F.split_part(F.col("__read"), F.lit("\u0001"), F.lit(i)), F.lit(","))
    s3 = s2.withColumns({"__unit": F.coalesce(part(1), F.lit("")), "__cur": F.coalesce(part(2), F.lit(""))})
    fits = (F.col("__rest") == "#") | (F.col("__read").contains("\u0001") & ~F.col("__unit").contains(",") & ~F.col("__cur").contains(","))
    s4 = s3.withColumn("number", F.when(fits & (F.col("__value") > 0) & (F.col("__value") < F.lit(float("inf"))), F.col("__value")))
    named = lambda c: F.when(F.col("number").isNotNull() & (F.col(c) != ""), F.col(c))
    return s4.withColumns({"unit_word": named("__unit"), "currency_word": named("__cur")}).drop("__plain", "__num", "__rest", "__read", "__unit", "__cur", "__value")


def is_unknown(text: Column) -> Column:
    return text.isNull() | strip(text).isin("", *UNKNOWN)


def _real_day(v: Column) -> Column:
    return v.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~v.startswith("0000") & F.try_to_date(F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v), "yyyy-MM-dd").isNotNull() & ~v.contains("\n")


def _finite(v: Column) -> Column:
    n = F.when(v.rlike(NUMBER) & ~v.contains("\n"), v).try_cast("double")
    return F.when(F.abs(n) < F.lit(float("inf")), n)


def _prepared(cells: DataFrame) -> DataFrame:
    """Cells with what the checks look at. Stands below the join with the rules, so that it is computed once per cell."""
    scalar, raw = F.col("kind").isin("number", "text"), F.col("value")
    return (
        cells.withColumn("bare", F.when(scalar, strip(raw)))
        .withColumns({
            "number": _finite(F.col("bare")), "is_day": F.coalesce(_real_day(raw), F.lit(False)),
            "unknown": (F.col("kind") == "null") | ((F.col("kind") == "text") & F.col("bare").isin("", *UNKNOWN)),
            "digits": raw.rlike(r"^[0-9]+$") & ~raw.contains("\n"),
        })
    )


def _checks() -> dict[str, Column]:
    """Each check as a test of a prepared cell; null counts as failed."""
    kind, number, blank = F.col("kind"), F.col("number"), F.col("bare") == ""
    absent = (kind == "null") | ((kind == "text") & blank)
    return {
        "day": F.col("is_day"),
        "text_day": (kind == "text") & F.col("is_day"),
        "day_or_blank": blank | F.col("is_day"),
        "digits_or_blank": blank | F.col("digits"),
        "positive_or_unknown": F.col("unknown") | (number > 0),
        "present": kind != "null",
        "number_or_unknown": F.col("unknown") | number.isNotNull(),
        "positive": number > 0,
        "whole_or_absent": absent | ((number >= 0) & (number == F.floor(number))),
        "issued_flag": absent | number.isin(0.0, 1.0),
        "amount_or_unknown": kind != "text",
    }


def failures(parsed: DataFrame, tbl: str) -> DataFrame:
    """(tbl, row_id, reason) of the rows that do not load, one row per row id.

    If a row id repeats, the id fails as soon as one of its rows does.
    """
    # a fixed number of rows, whatever the data: always small enough to broadcast, while a shuffle
    # by column name would send every cell of a column to one task
    rules = F.broadcast(rule_table(parsed.sparkSession).where(F.col("tbl") == tbl).select("column_name", "rule", "rank"))
    checks, passed = _checks(), F.lit(True)
    for rule in dict.fromkeys(r for t, _, r, _ in RULES if t == tbl):
        passed = F.when(F.col("rule") == rule, F.coalesce(checks[rule], F.lit(False))).otherwise(passed)
    # a fault of the whole row takes the place of its cells, so that the text is parsed once
    whole = F.array(F.struct(*[F.lit(None).cast("string").alias(n) for n in ("column_name", "kind", "value")]))
    # for a plain explode the optimizer would add a filter on the array below it, and read every text twice
    listed = F.explode_outer(F.when(F.col("fault_rank").isNotNull(), whole).otherwise(F.col("cells"))).alias("cell")
    cells = parsed.select("row_id", "fault_rank", listed).where("cell is not null")
    failing = _prepared(cells.select("row_id", "fault_rank", "cell.*")).join(rules, "column_name", "left").where(F.col("fault_rank").isNotNull() | (F.col("rule").isNotNull() & ~passed))
    worst = failing.groupBy("row_id").agg(F.min(F.coalesce("fault_rank", "rank")).alias("rank"))
    reason = F.element_at(F.create_map(*[F.lit(x) for pair in REASONS[tbl].items() for x in pair]), F.col("rank"))
    return worst.select(F.lit(tbl).alias("tbl"), "row_id", reason.alias("reason"))


def loadable(df: DataFrame, row_id: str, failed: DataFrame) -> DataFrame:
    """The rows of df that load: all but those with a failure. Columns are kept as they are."""
    return df.join(failed.select(F.col("row_id").alias("__failed_id")), F.col(row_id).cast("long") == F.col("__failed_id"), "left_anti")
