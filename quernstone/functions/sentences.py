"""Sentences of a text with their places; windows over long ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sentence ends after a run of these marks, at a blank line, or at a full stop after one of A-Z, a-z, 0-9 and before a blank or the end.
_END = re.compile(r"[。！？!?；;]+|\n\s*\n|(?<=[A-Za-z0-9])\.(?=\s|$)")


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences, blanks at their ends left out; empty ones are no sentences."""
    out, start = [], 0
    for m in [*_END.finditer(text), None]:
        end = m.end() if m else len(text)
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        start = end
    return out


def windows(a: int, b: int, hits: list[int], *, size: int = 480, before: int = 160) -> list[tuple[int, int]]:
    """Windows of `size` characters over a long sentence: around its hits, else around places a window apart.

    A window begins `before` characters ahead of its place, but neither before
    the sentence nor so late that it would not be filled.
    """
    if b - a <= size:
        return [(a, b)]
    starts = (max(a, min(h - before, b - size)) for h in (hits or range(a, b, size)))
    return [(s, s + size) for s in dict.fromkeys(starts)]


def sentences(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, sentence_no, char_start, char_end) of every text, without a shuffle. Null texts have none."""
    id_type = df.select(id_column).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t) if t else [] for t in b.column(1).to_pylist()]
            owner = [i for i, f in enumerate(found) for _ in f]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(owner, pa.int64())), pa.array([n for f in found for n in range(len(f))], pa.int32()), pa.array([s for f in found for s, _ in f], pa.int64()), pa.array([e for f in found for _, e in f], pa.int64())],
                names=[id_column, "sentence_no", "char_start", "char_end"])

    return df.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {id_type}, sentence_no int, char_start bigint, char_end bigint")
