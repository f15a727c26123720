"""Term counts of many texts as arrays, and each text's most similar earlier one of its group; NumPy alone, for Arrow batches.

A term is one 64-bit number: a word of up to 12 letters and digits by its
characters, a pair of CJK characters or a single one by its code points, both
without loss, and a longer word by a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that are cut into terms at once.
SLICE = 1 << 20
#: Longest word that is its own number: 37 ** 12 < 2 ** 63.
LONGEST = 12
#: Classes of terms of which a text's norms bound its cosines. Rows of the matrix of bounds made at once.
CLASSES, TILE = 512, 256
#: By how much a bound in single precision may fall short of a cosine.
SLACK = 1e-4

_CJK = 37
_KIND = np.zeros(0x110000, np.uint8)
_KIND[ord("0") : ord("9") + 1] = np.arange(1, 11)
_KIND[ord("a") : ord("z") + 1] = np.arange(11, 37)
_KIND[0x3400:0x4DC0] = _KIND[0x4E00:0xA000] = _CJK
_POWERS = 37 ** np.arange(LONGEST, dtype=np.int64)
_PAIRS = 37**LONGEST


def _tokens(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) of every term of a text in lower case, in no order."""
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _KIND[chars]
    edges = np.diff(((kind > 0) & (kind < _CJK)).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    words, size = np.zeros(0, np.int64), end - start
    if len(start):
        at = np.flatnonzero((kind > 0) & (kind < _CJK))
        words = np.add.reduceat(kind[at] * _POWERS[np.minimum(np.repeat(end, size) - 1 - at, LONGEST - 1)], np.cumsum(size) - size)
        for i in np.flatnonzero(size > LONGEST):
            digest = hashlib.blake2b(joined[start[i] : end[i]].encode(), digest_size=8).digest()
            words[i] = ~(int.from_bytes(digest, "little") >> 1)
    cjk = kind == _CJK
    before, after = np.append(False, cjk[:-1]), np.append(cjk[1:], False)
    pairs, alone = np.flatnonzero(cjk & after), np.flatnonzero(cjk & ~before & ~after)
    wide = chars.astype(np.int64)
    return np.concatenate([start, pairs, alone]), np.concatenate([words, _PAIRS + (wide[pairs] << 16 | wide[pairs + 1]), _PAIRS + (wide[alone] << 16)])


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.utf8_length(pc.fill_null(texts, "")).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo, done = 0, 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        yield lo, hi
        lo, done = hi, int(ends[hi - 1])


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, tf) of texts in lower case, in the order of rows: one entry for each distinct term of a text. They are functions.text.terms() of the text."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo, hi in _slices(texts):
        some = [t or "" for t in texts.slice(lo, hi - lo).to_pylist()]
        place, number = _tokens("\n".join(some))
        begins = np.cumsum([0, *(len(t) + 1 for t in some[:-1])])
        known, code = np.unique(number, return_inverse=True)
        both, tf = np.unique((np.searchsorted(begins, place, "right") - 1) * len(known) + code, return_counts=True)
        if len(known):
            parts.append((lo + both // len(known), known[both % len(known)], tf))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits that depend on all bits of x (splitmix)."""
    z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _same(group: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Of each row the first row of its group with equal term counts, by 128 bits; itself if it has no terms."""
    first = np.arange(len(group))
    rows, at = np.unique(row, return_index=True)
    if len(rows):
        one = _mixed(term) * (_mixed(tf) | np.uint64(1))
        digests = [np.add.reduceat(x, at).tolist() for x in (one, _mixed(one))]
        seen: dict[tuple, int] = {}
        for r, *key in zip(rows.tolist(), group[rows].tolist(), *digests):
            first[r] = seen.setdefault(tuple(key), r)
    return first


def _bounded(norms: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """(place, earlier places) of rows of which the products of the norms reach the threshold. No cosine is above that sum (Cauchy and Schwarz in each class)."""
    for lo in range(0, len(norms), TILE):
        hi = min(lo + TILE, len(norms))
        late, early = np.nonzero(np.tril(norms[lo:hi] @ norms[:hi].T >= threshold - SLACK, lo - 1))
        cut = np.flatnonzero(np.diff(late)) + 1
        for l, e in zip(np.split(late, cut), np.split(early, cut)):
            if len(l):
                yield lo + int(l[0]), e


def nearest(group: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, match, cosine): each row's most similar earlier row of its group, at or above the threshold; the first of equal ones.

    Rows are sorted by group, and within it by what counts as earlier. Rows of
    equal counts stand for one another, so copies are not compared. Of the others
    every pair of a group is bounded by a matrix product, and those whose bound
    reaches the threshold get their cosine term by term. Cosines are compared and
    tested as rounded to nine places.
    """
    n = len(group)
    weight = (1 + np.log(tf)) * idf
    weight = weight / np.sqrt(np.bincount(row, weight * weight, n))[row]
    known, local = np.unique(term, return_inverse=True)
    begin = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(begin)
    first = _same(group, row, term, tf)
    heads = np.flatnonzero((first == np.arange(n)) & (size > 0))
    match, cosine = np.full(n, -1), np.zeros(n)
    dense, mass, part = np.zeros(len(known)), weight * weight, (_mixed(known) % np.uint64(CLASSES)).astype(np.int64)[local]
    for own in np.split(heads, np.flatnonzero(np.diff(group[heads])) + 1):
        if len(own) < 2:
            continue
        held = np.concatenate([np.arange(begin[h], begin[h + 1]) for h in own])
        cell = np.repeat(np.arange(len(own)), size[own]) * CLASSES + part[held]
        norms = np.sqrt(np.bincount(cell, mass[held], len(own) * CLASSES)).astype(np.float32).reshape(len(own), CLASSES)
        for late, early in _bounded(norms, threshold):
            r, others = own[late], own[early]
            mine = slice(begin[r], begin[r + 1])
            dense[local[mine]] = weight[mine]
            ends = np.cumsum(size[others])
            at = np.arange(ends[-1]) + np.repeat(begin[others] - ends + size[others], size[others])
            got = np.round(np.minimum(np.add.reduceat(weight[at] * dense[local[at]], ends - size[others]), 1.0), 9)
            dense[local[mine]] = 0.0
            best = int(got.argmax())
            if got[best] >= threshold:
                match[r], cosine[r] = others[best], got[best]
    copies = np.flatnonzero(first != np.arange(n))
    head = first[copies]
    also = cosine[head] == 1.0  # what equals the first one and comes before it is earlier still
    match[copies], cosine[copies] = np.where(also, match[head], head), 1.0
    found = np.flatnonzero((match >= 0) & (cosine >= threshold))
    return found, match[found], cosine[found]


# -- blocks of a table ---------------------------------------------------------


def count_block(texts: pa.Table) -> pa.Table:
    """(block, term, n): each term of a block, and in how many documents at home there it stands, which may be none."""
    t, home = texts["t"].combine_chunks(), texts["home"].combine_chunks().to_numpy(zero_copy_only=False)
    total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for lo, hi in _slices(t):
        row, term, _ = counts(t.slice(lo, hi - lo))
        term, at = np.unique(np.concatenate([total[0], term]), return_inverse=True)
        total = term, np.bincount(at, np.concatenate([total[1], home[lo:hi][row]]), len(term)).astype(np.int64)
    return pa.table({"block": np.full(len(total[0]), texts["block"][0].as_py(), np.int64), "term": total[0], "n": total[1]})


def match_block(texts: pa.Table, known: pa.Table, n: int, doc: str, group: str, order: Sequence[str], threshold: float) -> pa.Table:
    """(doc, similarity, place): of each document of a block its nearest earlier one in it, as place: the columns of order, and match.

    known: (term, df) of the terms that more than one of the corpus's n documents holds.
    """
    groups = texts[group].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    early = pc.sort_indices(texts.select([*order, doc] if doc not in order else order), sort_keys=[(c, "ascending") for c in dict.fromkeys([*order, doc])], null_placement="at_start").to_numpy()
    rows = early[np.argsort(groups[early], kind="stable")]
    row, term, tf = counts(texts["t"].combine_chunks().take(pa.array(rows)))
    terms, df = known["term"].to_numpy(), known["df"].to_numpy()
    by = np.argsort(terms)
    terms, df = np.append(terms[by], np.iinfo(np.int64).max), np.append(df[by], 1)
    at = np.searchsorted(terms, term)
    idf = np.log((1 + n) / (1 + np.where(terms[at] == term, df[at], 1))) + 1
    late, match, cosine = nearest(groups[rows], row, term, tf, idf, threshold)
    late, match = pa.array(rows[late]), pa.array(rows[match])
    one = lambda c, at: texts[c].combine_chunks().take(at)
    place = pa.StructArray.from_arrays([*(one(c, match) for c in order), one(doc, match)], names=[*(f"o{i}" for i in range(len(order))), "match"])
    return pa.table({doc: one(doc, late), "similarity": pa.array(cosine), "place": place})
