"""Delimited and line-based files, read strictly and in parallel.

Files are read as lines in splits of any size. Each split counts its lines and
quotation marks; running totals over the splits of a file then tell each line
its number and whether it begins inside a quoted cell, so that only the lines
of records that span several are brought together. Every cell is text. A header
must be complete, unique and without padding, and name the same columns in
every file; their order may differ. A row may be shorter than the header (the
rest is null) but not longer.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.operators.rejects import split_record
from quernstone.session import settled

#: Characters of the longest record that is put together; a longer one, as after a quote that is never closed, is rejected.
MOST_RECORD = 16 << 20


class HeaderError(ValueError):
    """The first line of a file is no usable header."""


class RecordError(ValueError):
    """A record cannot be read, and the caller asked for all or nothing."""


def header_of(line: str) -> list[str]:
    """Column names of a header line; a byte order mark before it is dropped."""
    try:
        names = next(csv.reader(io.StringIO(line.lstrip("﻿").rstrip("\r")), strict=True), [])
    except csv.Error as e:
        raise HeaderError(str(e)) from e
    if not names or any(not n or n != n.strip() for n in names):
        raise HeaderError("a column has no name, or blanks around it")
    if len(set(names)) < len(names):
        raise HeaderError("two columns have one name")
    return names


_COUNTED = "file string, block bigint, place bigint, value string, quotes int, before int, opens0 bigint, opens1 bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place of each line in its split, the parity of the quotes before it there, and the records of several lines
    begun so far, for a split that begins outside (opens0) and inside a quoted cell (opens1)."""
    held, place, quotes, opens = None, 0, 0, [0, 0]
    for b in batches:
        file, block = b.column(1).to_pylist(), b.column(2).to_numpy()
        edges = [0, *(i for i in range(1, b.num_rows) if block[i] != block[i - 1] or file[i] != file[i - 1]), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if held != (file[lo], block[lo]):
                held, place, quotes, opens = (file[lo], block[lo]), 0, 0, [0, 0]
            part = b.slice(lo, hi - lo)
            q = pc.count_substring(part.column(0), '"').to_numpy(zero_copy_only=False).astype(np.int64)
            before = (quotes + np.cumsum(q) - q) % 2
            begun = [opens[h] + np.cumsum((before == h) & (q % 2 == 1)) for h in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), pa.array(place + np.arange(hi - lo), pa.int64()), part.column(0), pa.array(q % 2, pa.int32()), pa.array(before, pa.int32()), *[pa.array(x, pa.int64()) for x in begun]],
                names=["file", "block", "place", "value", "quotes", "before", "opens0", "opens1"])
            place, quotes, opens = place + hi - lo, (quotes + int(q.sum())) % 2, [int(x[-1]) for x in begun]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value, quotes, inside, record_no) of text files, line_no from 1.

    inside: does the line begin inside a quoted cell? record_no numbers the
    records of several lines in their file; it means nothing on other lines.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    counted = settled(lines.mapInArrow(_count, _COUNTED))
    splits = counted.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), (F.sum("quotes") % 2).alias("odd"), F.max("opens0").alias("o0"), F.max("opens1").alias("o1"))
    # as many rows as a file has splits
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumns({"lines_before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "inside_at": F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2})
    splits = splits.withColumn("opened", F.when(F.col("inside_at") == 0, F.col("o0")).otherwise(F.col("o1")))
    splits = splits.withColumn("opened_before", F.coalesce(F.sum("opened").over(earlier), F.lit(0))).select("file", "block", "lines_before", "inside_at", "opened_before")
    x = counted.join(splits, ["file", "block"])
    own = F.when(F.col("inside_at") == 0, F.col("opens0")).otherwise(F.col("opens1"))
    return x.select("file", (F.col("lines_before") + F.col("place") + 1).alias("line_no"), "value", "quotes", ((F.col("inside_at") + F.col("before")) % 2 == 1).alias("inside"), (F.col("opened_before") + own).alias("record_no"))


def _records(lines: DataFrame) -> DataFrame:
    """(file, line_no, record): whole records; null where one is too long to be put together."""
    single = lines.where(~F.col("inside") & (F.col("quotes") == 0)).select("file", "line_no", F.col("value").alias("record"))
    several = lines.where(F.col("inside") | (F.col("quotes") == 1))
    sizes = several.groupBy("file", "record_no").agg(F.sum(F.length("value") + 1).alias("size"), F.min("line_no").alias("first"))
    parts = several.join(sizes.where(F.col("size") <= MOST_RECORD), ["file", "record_no"])
    whole = parts.groupBy("file", "record_no").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda p: p["value"]), "\n").alias("record"))
    too_long = sizes.where(F.col("size") > MOST_RECORD).select("file", F.col("first").alias("line_no"), F.lit(None).cast("string").alias("record"))
    return single.unionByName(whole.select("file", "line_no", "record")).unionByName(too_long)


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): all-text rows of CSV files, and (file, line_no, line, reason) of the others.

    reason is 'quoting' (a quote opens a cell and is not closed, a closed cell
    goes on, or a quote stands in a cell that does not open with one) or
    'column_count' (more cells than the header). Blank lines are no records.
    The driver sees the distinct header lines alone.
    """
    lines = numbered_lines(spark, path)
    heads = lines.where("line_no = 1").select("file", F.col("value").alias("head"))
    found = [r.head for r in heads.select("head").distinct().limit(1000).collect()]
    if not found:
        raise HeaderError("the file is empty")
    names = header_of(min(found))
    if any(set(header_of(h)) != set(names) for h in found):
        raise HeaderError("the files name different columns")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order: dict[str, list[int]] = {}
        for b in batches:
            cells, reasons = [], []
            for head, record in zip(b.column(3).to_pylist(), b.column(2).to_pylist()):
                if head not in order:
                    own = header_of(head)
                    order[head] = [own.index(n) for n in names]
                got = None if record is None else split_record(record[:-1] if record.endswith("\r") else record)
                reason = "quoting" if got is None else "column_count" if len(got) > len(names) else None
                reasons.append(reason)
                cells.append(None if reason else [got[i] if i < len(got) else None for i in order[head]])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(cells, pa.list_(pa.string())), pa.array(reasons, pa.string())], names=["file", "line_no", "line", "cells", "reason"])

    body = _records(lines.where("line_no > 1")).where("record is null or record not in ('', '\\r')").join(heads, "file")
    parsed = body.select("file", "line_no", "record", "head").mapInArrow(parse, "file string, line_no bigint, line string, cells array<string>, reason string")
    rows = parsed.where("reason is null").select(*[F.col("cells")[i].alias(n) for i, n in enumerate(names)])
    return rows, parsed.where("reason is not null").select("file", "line_no", "line", "reason")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, *, fatal: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): objects of JSON lines, and (file, line_no, line, reason) of lines that are none. Blank lines are no lines.

    With fatal=True the first rejected line is an error instead.
    """
    lines = numbered_lines(spark, path).select("file", "line_no", F.regexp_replace("value", "\r$", "").alias("value")).where(F.trim("value") != "")
    corrupt = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    parsed = lines.withColumn("o", F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt", "allowNonNumericNumbers": "false"}))
    reason = F.when(F.col("o").isNull() | F.col("o.__corrupt").isNotNull(), F.when(F.ltrim("value").startswith("{"), "invalid_json").otherwise("record_not_object"))
    marked = parsed.withColumn("reason", reason)
    rejected = marked.where("reason is not null").select("file", "line_no", F.col("value").alias("line"), "reason")
    if fatal and (first := rejected.orderBy("file", "line_no").limit(1).collect()):
        raise RecordError(f"{first[0].file}, line {first[0].line_no}: {first[0].reason}")
    return marked.where("reason is null").select(*[F.col(f"o.{f.name}").alias(f.name) for f in schema.fields]), rejected
