"""Text as it is compared, with a map back to the text as it stands; term patterns, expansion and qualifiers of a query."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.functions.text import normal

_HAN = "㐀-鿿"
#: Blanks between two Chinese characters: a line break inside a word.
TORN = rf"(?<=[{_HAN}])\s+(?=[{_HAN}])"
_TORN = re.compile(TORN)
# Fixed value: what counts as one word of a query.
_WORD = re.compile(r"[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*")


def analysis_text(text: Column) -> Column:
    """text with the blanks between two Chinese characters away."""
    return F.regexp_replace(text, "(?U)" + TORN, "")


def matching_text(text: str) -> tuple[str, np.ndarray]:
    """(text to match in, place in the given text of each of its characters).

    NFKC and full case folding, character by character, blanks inside Chinese
    words away. A character that becomes several maps all of them to its place.
    """
    keep = np.ones(len(text), bool)
    for m in _TORN.finditer(text):
        keep[m.start() : m.end()] = False
    if text.isascii():
        return text.lower(), np.arange(len(text))
    out, places = [], []
    for i in np.flatnonzero(keep).tolist():
        folded = unicodedata.normalize("NFKC", text[i]).casefold()
        out.append(folded)
        places.extend([i] * len(folded))
    return "".join(out), np.array(places, np.int64)


def matched(text: Column) -> Column:
    """struct<shown, places> of a column: matching_text of every value."""

    @F.arrow_udf("struct<shown:string, places:array<int>>")
    def run(texts: pa.Array) -> pa.Array:
        pairs = [None if t is None else matching_text(t) for t in texts.to_pylist()]
        return pa.array([None if p is None else {"shown": p[0], "places": p[1].tolist()} for p in pairs], pa.struct([("shown", pa.string()), ("places", pa.list_(pa.int32()))]))

    return run(text)


def term_pattern(term: str) -> str:
    """A pattern for a term, for Spark and Python alike: any blanks between its words, and no letter or digit of ASCII
    beside an end that is one."""
    parts = term.split()
    body = r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in parts)
    guard = lambda c: bool(c) and c.isascii() and c.isalnum()
    front = "(?<![A-Za-z0-9])" if parts and guard(parts[0][0]) else ""
    back = "(?![A-Za-z0-9])" if parts and guard(parts[-1][-1]) else ""
    return f"{front}{body}{back}"


def expand(query: str, dictionary: Mapping[str, Sequence[str]]) -> tuple[list[str], list[str]]:
    """(terms, themes): the query beside all names of every theme that it names, each form once, in order of their normal forms."""
    asked = unicodedata.normalize("NFKC", query).strip()
    themes = [t for t in sorted(dictionary, key=normal) if any(re.search(term_pattern(name), asked, re.I) for name in (t, *dictionary[t]))]
    terms: dict[str, str] = {}
    for term in (asked, *(name for t in themes for name in (t, *dictionary[t]))):
        terms.setdefault(normal(term), term)
    return [terms[k] for k in sorted(terms)], themes


def qualifiers(query: str) -> list[str]:
    """What of a query must be met literally: its words of letters and digits together, as names of models are."""
    return sorted({normal(w) for w in _WORD.findall(unicodedata.normalize("NFKC", query)) if any(c.isalpha() for c in w) and any(c.isdigit() for c in w)})
