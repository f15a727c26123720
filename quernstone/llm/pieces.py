"""Oversized texts cut into overlapping pieces at natural boundaries.

Every position of a text has a boundary strength. A sparse table over the
strengths answers "the strongest cut in this window, the rightmost among
equals" in constant time; each piece takes the strongest cut among the lengths
it may have, and the next piece starts `overlap` characters before that cut.

The texts of an Arrow batch are laid end to end and cut together: one round of
array operations finds the next cut of every text that still has one, so the
number of Python steps follows the longest text and not the number of texts.
Positions are zero-based, end-exclusive and count code points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the delivered pieces.
LIMIT, OVERLAP, LEAST = 480, 80, 240
#: Characters laid end to end at once; bounds the memory of the sparse table.
CHUNK_CHARS = 1_000_000

# Strengths of a cut, weakest first. From NATURAL on, a cut is a natural boundary.
INSIDE, ANY, BLANK, CLAUSE, NATURAL, SENTENCE, LINE, PARAGRAPH = range(8)

_STOPS_ALWAYS = np.array(sorted(map(ord, "。！？")), np.uint32)
_STOPS_BEFORE_BLANK = np.array(sorted(map(ord, ".!?")), np.uint32)
_AFTER_STOP = np.array(sorted(map(ord, " \r\n")), np.uint32)
_CLAUSE_MARKS = np.array(sorted(map(ord, "，、：,;:")), np.uint32)
_BLANKS = np.array(sorted(map(ord, " \t\r　 ")), np.uint32)
LF, SEMICOLON = ord("\n"), ord("；")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _among(c: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, c), len(table) - 1)] == c


def strengths(c: np.ndarray) -> np.ndarray:
    """Strength of the cut before each position 1..len(c) of the code points c, at index position - 1.

    The last entry is the cut after the last character, as if no character followed.
    """
    after = np.append(c[1:], 0)
    s = np.full(len(c), ANY, np.uint32)
    # a cut before a combining mark, a selector or a joiner, or after a joiner, would tear one visible character
    joins = ((after >= 0x300) & (after < 0x370)) | ((after >= 0xFE00) & (after < 0xFE10)) | (after == 0x200D) | (c == 0x200D) | ((after >= 0x1F3FB) & (after <= 0x1F3FF))
    s[joins] = INSIDE
    s[_among(c, _BLANKS)] = BLANK
    s[_among(c, _CLAUSE_MARKS)] = CLAUSE
    s[c == SEMICOLON] = NATURAL
    s[_among(c, _STOPS_ALWAYS) | (_among(c, _STOPS_BEFORE_BLANK) & _among(after, _AFTER_STOP))] = SENTENCE
    line = c == LF
    s[line] = LINE
    before = np.insert(c[:-1], 0, 0)[: len(c)]
    s[line & ((before == LF) | ((before == 13) & (np.insert(before[:-1], 0, 0)[: len(c)] == LF)))] = PARAGRAPH
    return s


class StrongestCut:
    """Sparse table: level k holds, at i, the best key of the 2**k positions from i on."""

    _SHIFT = np.uint64(48)

    def __init__(self, strength: np.ndarray, widest: int):
        """strength: of the cut before position i + 1; widest: the longest window asked for."""
        key = (strength.astype(np.uint64) << self._SHIFT) | np.arange(1, len(strength) + 1, dtype=np.uint64)
        self.levels = [key]
        span = 1
        while 2 * span <= min(widest, len(key)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-span], last[span:]))
            span *= 2

    def query(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(strength, position) of the strongest, then rightmost cut in each window first..last (inclusive).

        An empty window has strength 0 and position 0.
        """
        width = last - first + 1
        best = np.zeros(len(first), np.uint64)
        level = np.frexp(np.maximum(width, 1).astype(float))[1] - 1
        for k in np.unique(level[width > 0]):
            on = np.flatnonzero((width > 0) & (level == k))
            t = self.levels[k]
            best[on] = np.maximum(t[first[on] - 1], t[last[on] - (1 << int(k))])
        return best >> self._SHIFT, (best & np.uint64((1 << 48) - 1)).astype(np.int64)


@dataclass
class Laid:
    """Texts laid end to end."""

    points: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @staticmethod
    def of(texts: Sequence[str]) -> Laid:
        c = code_points("".join(texts))
        end = np.cumsum([len(t) for t in texts], dtype=np.int64)
        return Laid(c, end - np.array([len(t) for t in texts], np.int64), end)

    def strengths(self) -> np.ndarray:
        s = strengths(self.points)
        filled = self.end[self.end > self.begin]
        if len(filled) > 1:
            # what follows a text's last character is no part of it
            seams = filled[:-1] - 1
            s[seams] = np.where(_among(self.points[seams], _STOPS_BEFORE_BLANK), ANY, s[seams])
        return s


def cut(texts: Sequence[str], *, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[list[tuple[int, int]]]:
    """(start, end) of the pieces of each text; a text within the limit is one piece, an empty one none.

    A cut lies more than `least` and at most `limit` characters after the start of its piece.
    """
    if not 0 <= overlap <= least < limit:
        raise ValueError("0 <= overlap <= least < limit is needed")
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for lo, hi in _chunks([len(t) for t in texts]):
        laid = Laid.of(texts[lo:hi])
        table = None
        at, start, end = np.flatnonzero(laid.end > laid.begin), None, None
        start, end = laid.begin[at].copy(), laid.end[at]
        while len(at):
            stop = end.copy()
            long = np.flatnonzero(end - start > limit)
            if len(long):
                table = table or StrongestCut(laid.strengths(), limit - least)
                stop[long] = table.query(start[long] + least + 1, start[long] + limit)[1]
            for i, a, b in zip(at.tolist(), (start - laid.begin[at]).tolist(), (stop - laid.begin[at]).tolist()):
                out[lo + i].append((a, b))
            at, start, end = at[long], stop[long] - overlap, end[long]
    return out


def _chunks(lengths: Sequence[int]) -> Iterator[tuple[int, int]]:
    lo, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > CHUNK_CHARS:
            yield lo, i
            lo, held = i, 0
        held += n
    if lengths:
        yield lo, len(lengths)


def holds_natural_cut(spans: Sequence[str], *, least: int = LEAST) -> np.ndarray:
    """For each span of a text: does a natural boundary lie after `least` characters and before its end?"""
    out = np.zeros(len(spans), bool)
    for lo, hi in _chunks([len(s) for s in spans]):
        laid = Laid.of(spans[lo:hi])
        if len(laid.points):
            widest = int((laid.end - laid.begin).max())
            strength, _ = StrongestCut(laid.strengths(), widest).query(laid.begin + least + 1, laid.end - 1)
            out[lo:hi] = strength >= NATURAL
    return out


def ends_naturally(spans: Sequence[str], following: Sequence[str]) -> np.ndarray:
    """For each span and the character after it ('' at the end of the text): is the span's end a natural boundary?"""
    last = code_points("".join(s[-1:] or "\0" for s in spans))
    after = code_points("".join(f[:1] or "\0" for f in following))
    return (last == LF) | (last == SEMICOLON) | _among(last, _STOPS_ALWAYS) | (_among(last, _STOPS_BEFORE_BLANK) & _among(after, _AFTER_STOP))


# -- DataFrames --------------------------------------------------------------

PIECES = "piece_no int, char_start bigint, char_end bigint, piece string"


def split_texts(df: DataFrame, id_column: str, text_column: str, *, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(id, piece_no, char_start, char_end, piece) of every text, without a shuffle.

    Null and empty texts have no piece; a text within the limit is one piece.
    Repeated rows give repeated pieces. Other columns are ignored.
    """
    id_type = df.select(id_column).schema[0].dataType.simpleString()
    schema = pa.schema([("piece_no", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for lo, hi in _chunks([len(t) for t in texts]):
                part = texts[lo:hi]
                cuts = cut(part, limit=limit, overlap=overlap, least=least)
                owner = [lo + i for i, c in enumerate(cuts) for _ in c]
                arrays = [
                    b.column(0).take(pa.array(owner, pa.int64())),
                    pa.array([n for c in cuts for n in range(len(c))], pa.int32()),
                    pa.array([a for c in cuts for a, _ in c], pa.int64()),
                    pa.array([e for c in cuts for _, e in c], pa.int64()),
                    pa.array([t[a:e] for t, c in zip(part, cuts) for a, e in c], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_column, *schema.names])

    return df.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {id_type}, {PIECES}")


def _badly_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans, following = b.column(1).to_pylist(), [f or "" for f in b.column(2).to_pylist()]
        bad = holds_natural_cut(spans) & ~ends_naturally(spans, following)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(bad))], names=["result_id"])


def improper_pieces(results: DataFrame, documents: DataFrame) -> DataFrame:
    """result_id of the rows of results that are no proper piece of documents, each once.

    A row is improper if it is longer than the limit, lies outside its text, is
    not exactly the stated span, does not start `OVERLAP` characters before the
    end of a piece before it (of equal query and document, with the preceding
    piece_no; where that place is held more than once, one fitting holder is
    enough), or ends at neither the text's end nor a natural boundary though
    one lies in its window. A null position, excerpt or document counts as
    outside the text; a null piece_no or query has no piece before it.

    The text itself travels once, to the rows of its document; what goes to
    Python is the excerpt, already known to equal the span, and one character.
    """
    r = results.select("result_id", "doc_id", "char_start", "char_end", "exact_excerpt")
    d = documents.select(F.col("doc_id").alias("text_of"), F.col("text").alias("whole"))
    start, end = F.col("char_start"), F.col("char_end")
    span_length = (end - start).cast("int")
    stated = (start >= 0) & (end >= start) & (end - start <= LIMIT) & (end <= F.length("whole"))
    exact = F.substring("whole", (start + 1).cast("int"), span_length) == F.col("exact_excerpt")
    judged = r.join(d, r.doc_id == d.text_of, "left").select(
        "result_id", F.coalesce(stated & exact, F.lit(False)).alias("is_span"), (end == F.length("whole")).alias("at_end"),
        "exact_excerpt", F.substring("whole", (end + 1).cast("int"), F.lit(1)).alias("following"),
    )
    # one pass of the join for both kinds of fault
    kept = judged.where("not is_span or not at_end").select(
        "result_id", F.when(F.col("is_span"), F.col("exact_excerpt")).alias("exact_excerpt"), F.when(F.col("is_span"), F.col("following")).alias("following"))
    faulty = kept.mapInArrow(_faulty, "result_id bigint")

    places = results.select("result_id", "query_id", "doc_id", "piece_no", "char_start", "char_end")
    before = places.groupBy("query_id", "doc_id", (F.col("piece_no") + 1).alias("piece_no")).agg(F.collect_set("char_end").alias("ends"))
    torn = places.join(before, ["query_id", "doc_id", "piece_no"]).where(~F.coalesce(F.array_contains("ends", F.col("char_start") + OVERLAP), F.lit(False))).select("result_id")
    return faulty.unionByName(torn).distinct()


def _faulty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without an excerpt are no spans and faulty; the others are tested for their cut."""
    for b in batches:
        missing = b.column(1).is_null()
        yield pa.RecordBatch.from_arrays([b.column(0).filter(missing)], names=["result_id"])
        yield from _badly_cut([b.filter(missing.to_numpy(zero_copy_only=False) == False)])  # noqa: E712
