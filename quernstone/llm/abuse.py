"""Scores of abusive, hateful or sexual passages, by a weighted finite-state grammar.

1. Rewriting steps undo disguises (look-alike letters, digits for letters,
   separators inside words, drawn-out letters, masked words).
2. A lexical transducer, an Aho-Corasick automaton over the inflected words of
   llm.lexicon, turns the sentences around a hit into strings of symbols.
3. llm.grammar scores the clauses of these strings: transducers of insult,
   threat, hatred and sex over targets, composed with those of negation and
   reported speech. A text's score is that of its best clause.

Whole texts are read. Most texts hold no word without which no path can match,
and cost one pass of the automaton.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm import grammar, lexicon, visible
from quernstone.llm.grammar import CATEGORIES

#: Score from which a text counts as unwelcome.
THRESHOLD = 0.5

# -- rewriting ---------------------------------------------------------------

@lru_cache(1)
def _plain_table() -> dict[int, str | None]:
    common, rare, many = visible.tables()
    table: dict[int, str | None] = {ord(a): b for m in (common, rare, many) for a, b in m.items()}
    table |= {c: None for a, b in visible.INVISIBLE for c in range(a, min(b, 0xFFFF) + 1)}
    table |= {ord(a): b for a, b in zip("’‘´`＊×", "''''**")}
    return table


def plain(text: str) -> str:
    """text in visible form and without case."""
    # case goes first, as capitals look alike where small letters do not
    return unicodedata.normalize("NFC", text.casefold().translate(_plain_table())).casefold()


_LEET = str.maketrans("0134579@$!|€+", "oieastgasiiet")
_LEET_CHARS = "0-9@$!|€+"
_LETTER = "a-zß-ɏа-ӿ"
_MIXED = re.compile(rf"(?<![{_LETTER}{_LEET_CHARS}])(?=[{_LEET_CHARS}]*[{_LETTER}])(?=[{_LETTER}]*[{_LEET_CHARS}])[{_LETTER}{_LEET_CHARS}]{{2,}}(?![{_LETTER}{_LEET_CHARS}])")
_SPACED = re.compile(rf"(?<![{_LETTER}])[{_LETTER}]([ ._\-*~·])[{_LETTER}](?:(?:\1|\1 \1|\1{{3}})[{_LETTER}])+(?:\1[{_LETTER}]{{2}}|s)?(?![{_LETTER}])")
_CJK = "一-鿿㐀-䶿"
_TORN = re.compile(rf"[ ._\-*~·]{{1,2}}(?=[{_CJK}])")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_MASKED = re.compile(rf"(?<![{_LETTER}*])([{_LETTER}])(\*{{2,}})([{_LETTER}]{{1,3}})(?![{_LETTER}*])")
_BLANKS = re.compile(r" {2,}")
_SEPARATOR = re.compile(r"[ ._\-*~·]+")


def _unleet(m: re.Match) -> str:
    """A word with letters for its digits and signs: the reading that the lexicon knows, else that with i for 1, ! and |."""
    word = m.group()
    core = word.rstrip("!")
    read = core.translate(_LEET)
    known = lexical().known
    if read not in known and any(c in "1!|" for c in core):
        other = "".join("l" if c in "1!|" else c for c in core).translate(_LEET)
        if other in known:
            read = other
    return word if sum(c.isalpha() for c in word) < 2 and read not in known else read + word[len(core) :]


def _joined(m: re.Match) -> str:
    word = _SEPARATOR.sub("", m.group())
    # with blanks between, a first letter may be a word of its own
    return f"{word} {word[1:]}" if m.group(1) == " " and word[0] in "ai" else word


def _mend(text: str) -> str:
    """Separators between two Chinese characters away; line starts and lists keep theirs."""
    out, last = [], 0
    for m in _TORN.finditer(text):
        a = m.start()
        if a and "㐀" <= text[a - 1] <= "鿿":
            out.append(text[last:a])
            last = m.end()
    return "".join([*out, text[last:]]) if out else text


_STARRED = re.compile(rf"([{_CJK}])\*{{1,2}}([{_CJK}])")


def _unstar(m: re.Match) -> str:
    """A Chinese word with its middle masked, written out; other stars are separators."""
    return lexical().middles.get((m.group(1), m.group(2)), m.group())


#: Latin letters that look like Cyrillic capitals, inside a word that has Cyrillic ones.
_CAPITALS = str.maketrans("bhkmt", "внкмт")
_CYRILLIC_WORD = re.compile(r"[a-zа-ӿ]*[а-ӿ][a-zа-ӿ]*")


def _suspicious(texts: Sequence[str]) -> np.ndarray:
    """Bit mask per text: 1 mixed letters and digits or signs, 2 spaced letters, 4 drawn-out letters, 8 mixed scripts."""
    c = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    letter = ((c >= 97) & (c <= 122)) | ((c >= 0xDF) & (c < 0x250)) | ((c >= 0x430) & (c < 0x500))
    leet = ((c >= 48) & (c <= 57)) | (c == 64) | (c == 36) | (c == 33) | (c == 124) | (c == 0x20AC)
    flags = np.zeros(len(c), np.uint8)
    flags[:-1][(letter[:-1] & leet[1:]) | (leet[:-1] & letter[1:])] |= 1
    latin, cyrillic = (c == 98) | (c == 104) | (c == 107) | (c == 109) | (c == 116), (c >= 0x430) & (c < 0x500)
    flags[:-1][(latin[:-1] & cyrillic[1:]) | (cyrillic[:-1] & latin[1:])] |= 8
    alone = letter.copy()
    alone[1:] &= ~letter[:-1]
    alone[:-1] &= ~letter[1:]
    if len(c) > 4:
        flags[:-4][alone[:-4] & alone[2:-2] & alone[4:]] |= 2
        flags[:-2][letter[:-2] & (c[:-2] == c[1:-1]) & (c[1:-1] == c[2:])] |= 4
    starts = np.concatenate([[0], ends[:-1]])
    return np.bitwise_or.reduceat(flags, starts) if len(texts) else np.zeros(0, np.uint8)


def reveal(texts: Sequence[str]) -> list[str]:
    """Texts in plain form, disguised words written out."""
    out = [plain(t) for t in texts]
    for i, mask in enumerate(_suspicious(out)):
        t = out[i]
        if mask & 8:
            t = _CYRILLIC_WORD.sub(lambda m: m.group().translate(_CAPITALS), t)
        if mask & 2:
            t = _SPACED.sub(_joined, t)
        if mask & 1:
            t = _MIXED.sub(_unleet, t)
        if mask & 4:
            t = _DRAWN.sub(r"\1", t)
        if "  " in t:
            t = _BLANKS.sub(" ", t)
        if "*" in t:
            t = _STARRED.sub(_unstar, t)
        out[i] = _mend(t)
    return out


# -- the lexical transducer ---------------------------------------------------

def _is_cjk(word: str) -> bool:
    return any("㐀" <= c <= "鿿" for c in word)


class Lexical:
    """The automata over all words, and over those without which no path matches."""

    def __init__(self) -> None:
        import ahocorasick

        traditional = str.maketrans(lexicon.SIMPLIFIED, lexicon.TRADITIONAL)
        kinds: dict[str, set[str]] = {}
        #: Ends of words that may be masked by stars, and Chinese words by theirs.
        self.masked: set[tuple[str, int, str]] = set()
        self.middles: dict[tuple[str, str], str] = {}
        for raw, names in grammar.classes().items():
            cjk, insulting = _is_cjk(raw), bool(names & {"SLUR", "INSULT"})
            variants = {raw, raw.translate(traditional)} if cjk else {raw}
            if cjk and len(raw) > 1 and names & {"SLUR", "INSULT", "EXPLICIT"}:
                # one character spelled by its sound
                for spelling in (lexicon.SOUNDS, lexicon.DIGITS):
                    variants |= {raw[:i] + spelling[c] + raw[i + 1 :] for i, c in enumerate(raw) if c in spelling}
            for v in variants:
                word = plain(v)
                forms = {word}
                if insulting:
                    if not cjk:
                        forms.add(_DRAWN.sub(r"\1", re.sub(r"([^\W\d_])\1", r"\1", word)))
                        if " " not in word and len(word) >= 4:
                            self.masked.add((word[0], len(word), word[-1]))
                    elif len(word) == 3:
                        self.middles.setdefault((word[0], word[2]), word)
                for f in forms:
                    kinds.setdefault(f, set()).update(names)
        # what a harmless compound covers is no word of its own
        sets = {w: frozenset() if "HARMLESS" in k else frozenset(k) for w, k in kinds.items()}
        self.symbols = grammar.Symbols({k for k in sets.values() if k} | {frozenset({"MASKED", "INSULT"})})
        self.grammar = grammar.Grammar(self.symbols)
        self.mask_symbol = self.symbols.of[frozenset({"MASKED", "INSULT"})]
        self.full, self.content = ahocorasick.Automaton(), ahocorasick.Automaton()
        for w, k in sets.items():
            self.full.add_word(w, (len(w), self.symbols.of[k] if k else grammar.OTHER, not _edge(w[0]), not _edge(w[-1])))
            if k & grammar.CONTENT or not k:
                self.content.add_word(w, (len(w), bool(k), not _edge(w[0]), not _edge(w[-1])))
        #: Single words, to choose among the readings of a disguised one.
        self.known = {w for w, k in sets.items() if k and " " not in w}
        self.full.make_automaton()
        self.content.make_automaton()

    @staticmethod
    def words(text: str, automaton, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, int, object]]:
        """(start, end, value) of the words of a list within a text."""
        n = len(text)
        for last, (length, value, front, back) in automaton.iter(text, lo, n if hi is None else hi):
            a, b = last - length + 1, last + 1
            if front and a and _joins(text[a - 1]) or back and b < n and _joins(text[b]):
                continue
            yield a, b, value

    def hits(self, text: str) -> list[int]:
        """Places of the words without which no path matches, harmless compounds taken out."""
        found, hidden = [], []
        for a, b, value in self.words(text, self.content):
            if value:
                found.append((a, b))
            else:
                hidden.append((a, b))
        if hidden and found:
            cover = np.zeros(len(text) + 1, np.int32)
            np.add.at(cover, [a for a, _ in hidden], 1)
            np.add.at(cover, [b for _, b in hidden], -1)
            bare = np.concatenate([[0], np.cumsum(np.cumsum(cover) == 0)])
            found = [(a, b) for a, b in found if bare[b] > bare[a]]
        return [a for a, _ in found]

    def symbol_string(self, text: str, lo: int, hi: int) -> str:
        """The symbols of a stretch of text: at each place the longest word of the lists, then what is left between."""
        longest: dict[int, tuple[int, str]] = {}
        for a, b, c in self.words(text, self.full, lo, hi):
            if b > longest.get(a, (0, ""))[0]:
                longest[a] = b, c
        if "**" in text[lo:hi]:
            for m in _MASKED.finditer(text, lo, hi):
                if _could_be(m, self.masked):
                    longest[m.start()] = m.end(), self.mask_symbol
        out, at = [], lo
        for a in sorted(longest):
            if a >= at:
                _between(text, at, a, out)
                at, c = longest[a]
                out.append(c)
        _between(text, at, hi, out)
        return "".join(out)


def _edge(c: str) -> bool:
    """May this end of a word touch letters? So of Chinese ones and of signs."""
    return "㐀" <= c <= "鿿" or not c.isalnum()


def _joins(c: str) -> bool:
    return c.isalnum() and not "㐀" <= c <= "鿿"


_PIECES = re.compile(r"[㐀-鿿]{1,2}|[^\W_㐀-鿿]+|[,，、]|[:：]|[\"“”„«»「」『』‹›‘]| [—–-] |—|[()（）\[\]]|" + "'")
_PIECE_SIGN = {**dict.fromkeys(",，、()（）[]", grammar.COMMA), **dict.fromkeys(":：", grammar.COLON), **dict.fromkeys("\"“”„«»「」『』‹›‘", grammar.QUOTE)}


def _between(text: str, a: int, b: int, out: list[str]) -> None:
    """Symbols of what is on no list: words as they come, Chinese characters by twos, signs."""
    for m in _PIECES.finditer(text, a, b):
        c = m.group()
        if c != "'":
            out.append(_PIECE_SIGN.get(c, grammar.OTHER))


@lru_cache(1)
def lexical() -> Lexical:
    return Lexical()


_STOP = re.compile(r"[。！？；!?;\n…\U0001f300-\U0001faff]+|\.(?=\s|$)|(?<=[%\d]) (?=[a-zа-яß-ɏ]{3})")


def text_scores(text: str, hits: Sequence[int], lex: Lexical) -> dict[str, float]:
    """Best weight of each category over the sentences of a revealed text that hold a hit, each with its neighbours."""
    ends = [m.end() for m in _STOP.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    which = np.unique(np.searchsorted(ends, np.asarray(hits), side="right"))
    wanted = np.unique(np.clip(np.concatenate([which - 1, which, which + 1]), 0, len(ends) - 1))
    parts, last = [], None
    for i in wanted.tolist():
        if last is not None:
            parts.append(grammar.STOP if i == last + 1 else grammar.BREAK)
        parts.append(lex.symbol_string(text, ends[i - 1] if i else 0, ends[i]))
        last = i
    return lex.grammar.scores("".join(parts))


def score_texts(texts: Sequence[str | None]) -> list[dict[str, float]]:
    """Weights by category of each text; none for null and empty texts."""
    lex = lexical()
    shown = [i for i, t in enumerate(texts) if t]
    out: list[dict[str, float]] = [{} for _ in texts]
    for i, text in zip(shown, reveal([texts[i] for i in shown])):
        hits = lex.hits(text)
        if "**" in text:
            hits += [m.start() for m in _MASKED.finditer(text) if _could_be(m, lex.masked)]
        if hits:
            out[i] = text_scores(text, hits, lex)
    return out


def _could_be(m: re.Match, masked: set) -> bool:
    length, tail = m.end() - m.start(), m.group(3)
    ends = [(length, tail[-1])] + ([(length - 1, tail[-2])] if tail[-1] == "s" and len(tail) > 1 else [])
    return any((m.group(1), n, last) in masked for n, last in ends)


# -- DataFrames --------------------------------------------------------------

SCORES = "score double, category string, insult double, threat double, hate double, sexual double"


def score_column(df: DataFrame, id_column: str, text_column: str, *keep: str) -> DataFrame:
    """(id, kept columns, score, category, one weight per category) of every row, without a shuffle.

    score is the best weight, 0 for null and empty texts; category is that of
    the best weight, null where the score is 0, and the first of CATEGORIES
    among equals. Repeated rows are scored as often as they come.
    """
    head = df.select(id_column, *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in head.schema)
    names = [*head.columns, "score", "category", *CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found = score_texts(part.column(part.num_columns - 1).to_pylist())
                tops = [max(CATEGORIES, key=lambda c: w.get(c, 0.0)) if w else None for w in found]
                arrays = [
                    *part.columns[:-1], pa.array([w[c] if c else 0.0 for w, c in zip(found, tops)], pa.float64()), pa.array(tops, pa.string()),
                    *[pa.array([w.get(c, 0.0) for w in found], pa.float64()) for c in CATEGORIES],
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(id_column, *keep, F.col(text_column).cast("string").alias("__text")).mapInArrow(run, f"{fields}, {SCORES}")


def rates(scored: DataFrame, group: str, *, threshold: float = THRESHOLD) -> DataFrame:
    """(group, texts, unwelcome, rate): share of texts at or above the threshold; a null group is a group."""
    hit = (F.col("score") >= threshold).cast("long")
    return scored.groupBy(group).agg(F.count(F.lit(1)).alias("texts"), F.sum(hit).alias("unwelcome"), F.round(F.avg(hit), 6).alias("rate"))
