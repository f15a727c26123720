"""The clause grammar of the abuse operator: transducers over the symbols of a text.

The lexical transducer of llm.abuse turns a text into a string of symbols, one
per word: each symbol is a set of word classes (a word may be several things).
Over it work four transducers, which are composed into the score of a clause:

* attack: paths over target, insult, threat, group and sexual symbols, with
  weights. A path names who is attacked by what: an insult needs a person it is
  said of, harm needs a person or a part of one as its object, and so on.
* negation: a denial governs what follows it in its clause, up to a comma that
  no conjunction follows, an adversative word or the end of the sentence.
* reported speech: a verb of speech that is not the writer's own, or a source
  (a court, a rule, a film) followed by a link, a colon or a quotation, governs
  the rest of its sentence; a quotation is governed by either at its other end.
* weight: what is governed keeps DAMPING of its weight.

A text's score in a category is that of its best clause.

Paths are written in a small notation: names of classes, joined by `|` where
any will do and marked `?`, `+` where they may be missing or repeated; `~n`
stands for up to n symbols of the same clause, `-n` for the same without verbs
of speech and links, `,n` for up to n symbols of the same sentence, `.n` of the
same passage; `END` and `START` for the edges of a clause.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

from quernstone.llm import lexicon

#: What remains of a weight that is denied or reported.
DAMPING = 0.35
CATEGORIES = ("insult", "threat", "hate", "sexual")

#: Signs of the symbol string beside words: other words, commas, colons, quotation marks, ends of sentences, gaps in the text.
OTHER, COMMA, COLON, QUOTE, STOP, BREAK = "o,:q.|"
_FIRST = 0xE000

THIRD = "THIRD|ROLE|KIN"
ANYONE = "YOU|YOUR|THIRD|THEY|ROLE|KIN"
VERBS = "KILL|HURT"

#: (category, weight, path). A final `*` marks paths that hold for reported words too.
PATHS = (
    ("insult", 0.8, "IDIOM"),
    ("insult", 0.95, "YOU|YOUR|SUCH|DISMISS ~2 SLUR"),
    ("insult", 0.7, "SLUR"),
    ("insult", 0.6, "MASKED"),
    ("insult", 0.75, "YOU ~3 INSULT"),
    ("insult", 0.75, "COP YOU ~3 INSULT|FOUL"),
    ("insult", 0.7, "COP YOU ~2 BEAST END"),
    ("insult", 0.7, "YOU ~1 COP ~3 INSULT|SLUR|FOUL"),
    ("insult", 0.7, "YOU ~1 COP ~3 BEAST END|FOUL"),
    ("insult", 0.7, "YOU ~1 COP ~2 FOUL|MEAN+ BEAST"),
    ("insult", 0.65, "YOU ~1 FOUL|MEAN+ INSULT|BEAST"),
    ("insult", 0.65, "YOU FOUL ROLE|YOU|THEY"),
    ("insult", 0.65, "YOU DEGREE? FOUL END"),
    ("insult", 0.65, "YOU DEGREE? BEAST END"),
    ("insult", 0.6, "INSULT|BEAST COMMA? YOU END"),
    ("insult", 0.6, "YOUR FOUL|MEAN+ INSULT|BEAST"),
    ("insult", 0.6, "YOUR MEAN? FOUL ROLE|KIN"),
    ("insult", 0.65, f"{THIRD}|THEY ~3 COP -5 INSULT"),
    ("insult", 0.65, f"YOU|{THIRD} ~4 COP ~3 DEHUM"),
    ("insult", 0.6, "COP ~1 FOUL|MEAN+ INSULT"),
    ("insult", 0.55, "COP ~1 INSULT END"),
    ("insult", 0.65, "YOU ~1 COMMA ~1 INSULT END"),
    ("insult", 0.65, "YOU ~1 MEAN? FOUL THING END|COMMA"),
    ("insult", 0.65, f"{THIRD}|THEY ~1 DEGREE ~2 INSULT"),
    ("insult", 0.6, f"{THIRD} ~4 COP ~2 BEAST END"),
    ("insult", 0.65, f"{THIRD}|THEY ~4 COP|DEGREE ~2 FOUL|MEAN+ BEAST|INSULT"),
    ("insult", 0.6, f"{THIRD} ~1 COP|DEGREE ~1 FOUL END|INSULT|BEAST"),
    ("insult", 0.7, "SUCH ~1 FOUL|MEAN? INSULT|SLUR"),
    ("insult", 0.65, "SUCH FOUL|MEAN+ BEAST"),
    ("insult", 0.65, "SUCH MEAN? FOUL ROLE"),
    ("insult", 0.65, f"YOU|{THIRD}|THEY COP? SUCH ~1 BEAST"),
    ("insult", 0.7, "DISMISS ,4 INSULT|SLUR|BEAST"),
    ("insult", 0.7, "INSULT|BEAST COMMA? ~1 DISMISS"),
    ("insult", 0.6, "START FOUL|MEAN+ INSULT|BEAST END"),
    ("insult", 0.6, "KIN|YOUR ~3 DESPISE -1 YOU"),
    ("insult", 0.7, "YOU ~2 INSULT|SLUR|BEAST ~4 FLATTER *"),
    ("threat", 0.85, "MENACE"),
    ("threat", 0.85, "SUICIDE"),
    ("threat", 0.85, "YOU|HURRY|MODAL ~4 SUIVERB"),
    ("threat", 0.8, "SELF ~5 KILL -1 YOU|YOUR|THIRD|THEY|ROLE|KIN|GROUP"),
    ("threat", 0.8, "SELF ~2 YOU|THIRD -2 KILL"),
    ("threat", 0.8, "LINK -1 YOU|THIRD|THEY|YOUR -1 KILL"),
    ("threat", 0.8, f"SELF|BEWARE|MODAL ~5 {VERBS} ~1 YOU|YOUR|THIRD|ROLE ~2 BODY"),
    ("threat", 0.8, f"{VERBS} -1 YOUR|YOU -1 BODY"),
    ("threat", 0.8, f"SELF|IHURT ~3 YOU|THIRD -2 BODY -1 {VERBS}|IHURT"),
    ("threat", 0.8, f"SELF -3 YOU|THIRD -1 {VERBS} -1 BODY"),
    ("threat", 0.8, "MODAL ~3 YOU|THIRD ~2 HURT ~3 BODY"),
    ("threat", 0.8, "YOU|YOUR|THIRD ~1 BODY -1 IHURT"),
    ("threat", 0.75, "BODY IHURT"),
    ("threat", 0.8, "IKILL -1 YOU|YOUR|THIRD|THEY|ROLE|GROUP"),
    ("threat", 0.8, "YOU|THIRD|THEY -2 IKILL"),
    ("threat", 0.8, "IHURT -1 YOU|YOUR"),
    ("threat", 0.75, "YOU -1 IHURT"),
    ("threat", 0.7, "SELF ~4 HURT YOU END|BODY"),
    ("threat", 0.8, "SELF -1 SEPVERB YOU|THIRD|THEY|ROLE -3 SEPPART"),
    ("threat", 0.75, "START HURRY? KILL THIRD|THEY|GROUP|REFL"),
    ("threat", 0.8, "KILL REFL END"),
    ("threat", 0.85, "START ~1 LEAP ~4 HEIGHT"),
    ("threat", 0.7, "MODAL -4 EXECUTE"),
    ("threat", 0.75, "YOUR|YOU ~1 KIN ~2 MENACE"),
    ("threat", 0.75, "THIRD|THEY|ROLE|YOU -3 MODAL -3 SLAIN|KILL|DIE"),
    ("threat", 0.75, "MODAL -3 THIRD|THEY|ROLE|YOU ~4 SLAIN|KILL"),
    ("threat", 0.75, "MODAL SLAIN|KILL -1 THIRD|THEY|ROLE|YOU"),
    ("threat", 0.75, "WISH COMMA? ~3 YOU|YOUR|THIRD|THEY|ROLE|KIN ~4 DIE|SLAIN"),
    ("threat", 0.7, "WISH ~1 DIE"),
    ("threat", 0.7, "THIRD|THEY|YOU FUT? SELF ~1 KILL"),
    ("threat", 0.7, "YOU|THIRD FUT -2 DIE"),
    ("threat", 0.8, "KNOW ~3 LIVE"),
    ("threat", 0.8, "KNOW ~1 YOU|YOUR ~6 LIVE"),
    ("threat", 0.7, "KIN ,4 MENACE"),
    ("threat", 0.6, "SELF FUT -3 HURT -1 THIRD|THEY|ROLE END"),
    ("threat", 0.75, "MODAL|SELF|THIRD|YOU ~4 BULLET ~3 BODY"),
    ("threat", 0.75, "SELF ~3 YOU|THIRD -4 WEAPON ~3 BODY"),
    ("threat", 0.75, "SELF ~5 HURT YOUR END"),
    ("threat", 0.75, "SELF|BEWARE ~6 STALK ~1 YOU|YOUR|KIN"),
    ("threat", 0.8, "SELF ~3 HUNT ~1 YOU ,3 KILL|IKILL|IHURT|HURT|SEPVERB"),
    ("threat", 0.8, "SELF|THIRD -1 YOU -1 HUNT ~2 KILL|IKILL|IHURT"),
    ("threat", 0.75, "SELF ~4 HUNT ~9 WEAPON"),
    ("threat", 0.75, "SHAME ~3 WEAPON|HURT|BODY"),
    ("hate", 0.85, "GROUP ~4 DEHUM"),
    ("hate", 0.8, "GROUP ~3 COMMA ,3 DEHUM"),
    ("hate", 0.8, "GROUP ~2 COP|DEGREE|SUCH ~3 INSULT|BEAST|SLUR"),
    ("hate", 0.75, "GROUP ~1 COP|DEGREE ~1 FOUL"),
    ("hate", 0.8, "GROUP ~3 MODAL -4 SLAIN|EXPEL|KILL"),
    ("hate", 0.8, "MODAL -2 GROUP ~4 SLAIN|EXPEL|KILL"),
    ("hate", 0.8, "MODAL|SELF -2 SLAIN|KILL -1 GROUP"),
    ("hate", 0.75, "EXPEL -3 GROUP"),
    ("hate", 0.75, "GROUP ,6 EXPEL"),
    ("hate", 0.65, "FOUL GROUP"),
    ("hate", 0.8, "ONLYGOOD ~3 GROUP ~7 GRAVE"),
    ("hate", 0.75, "FULL ~1 GROUP .3 STENCH"),
    ("sexual", 0.85, "EXPLICIT"),
    ("sexual", 0.8, "ACT|LUST -2 PART|ORGAN"),
    ("sexual", 0.75, "PART|ORGAN ~3 LUST"),
    ("sexual", 0.7, "ORGAN ~2 ACT"),
    ("sexual", 0.7, "ACT|LUST YOU|THIRD ~3 ACT|LUST"),
    ("sexual", 0.65, "SELF ~4 LUST YOU|THIRD"),
    ("sexual", 0.65, "SELF ~2 YOU|THIRD -1 LUST"),
    ("sexual", 0.7, "YOUR|THIRD -1 ORGAN"),
    ("sexual", 0.7, "BARE ~2 LURE ,5 LURE|ACT|PART|ORGAN"),
    ("sexual", 0.7, "LURE ~2 BARE ,5 LURE|ACT|PART|ORGAN"),
    ("sexual", 0.65, "BARE ~1 BARE ~2 LURE"),
    ("sexual", 0.65, "BARE ~1 PART|ORGAN"),
)
#: Classes of which every path holds one: a text without them is not parsed.
CONTENT = frozenset(
    "INSULT BEAST FOUL SLUR MASKED IDIOM DESPISE MENACE SUICIDE SUIVERB KILL HURT IKILL IHURT SLAIN DIE KNOW STALK HUNT SHAME SEPVERB DEHUM EXPEL GRAVE STENCH EXPLICIT ACT LUST BARE ORGAN HEIGHT EXECUTE BULLET WEAPON".split()
)
_SIGNS = {"COMMA": COMMA}


class Symbols:
    """The sets of classes that words have, each with a character of its own."""

    def __init__(self, kinds: set[frozenset[str]]):
        self.of = {k: chr(_FIRST + i) for i, k in enumerate(sorted(kinds, key=sorted))}
        self.kinds = {c: k for k, c in self.of.items()}

    def chars(self, name: str) -> str:
        """All characters whose set holds one of the classes."""
        names = set(name.split("|"))
        return "".join(c for k, c in self.of.items() if k & names) + "".join(_SIGNS[n] for n in names if n in _SIGNS)

    def compile(self, path: str) -> re.Pattern:
        parts = []
        stop, clause = re.escape(STOP + BREAK), re.escape(STOP + BREAK + COMMA + COLON)
        links = self.chars("LINK|CALL|BUT")
        but = self.chars("BUT")
        for item in path.split():
            if m := re.fullmatch(r"([~\-,.])(\d)", item):
                inside = {"~": f"[^{clause}{but}]", "-": f"[^{clause}{links}]", ",": f"[^{stop}]", ".": f"[^{re.escape(BREAK)}]"}[m.group(1)]
                parts.append(f"{inside}{{0,{m.group(2)}}}?")
            elif item == "START":
                parts.append(f"(?<![^{clause}{QUOTE}])")
            else:
                name, many = item.rstrip("?+"), item[len(item.rstrip("?+")) :]
                names = name.split("|")
                chars = self.chars("|".join(n for n in names if n != "END"))
                one = f"[{chars}]" if chars else ""
                if "END" in names:
                    edge = rf"(?=[{clause}{QUOTE}{but}])|\Z"
                    one = f"(?:{one}|{edge})" if one else f"(?:{edge})"
                parts.append({"": one, "?": f"{one}?", "+": f"{one}{{1,3}}"}[many])
        return re.compile("".join(parts))


def needs(path: str) -> list[set[str]]:
    """The classes of which a path needs one each."""
    return [set(i.split("|")) - {"END"} for i in path.rstrip("* ").split() if i[0] not in "~-,." and not i.endswith("?") and i not in ("START", "END") and "END" not in i.split("|")
            for i in [i.rstrip("+")]]


class Grammar:
    """The attack paths and the governing transducers over one set of symbols."""

    def __init__(self, symbols: Symbols):
        self.symbols = symbols
        self.paths = []
        for category, weight, path in sorted(PATHS, key=lambda p: -p[1]):
            free = path.endswith("*")
            classes = [symbols.chars("|".join(sorted(n))) for n in needs(path)]
            quick = re.compile("".join(f"(?=.*?[{c}])" for c in classes if c), re.DOTALL)
            self.paths.append((category, weight, symbols.compile(path.rstrip("* ")), quick, free))
        self._neg, self._notneg, self._call, self._case = (set(symbols.chars(n)) for n in ("NEG", "NOTNEG", "CALL", "CASE"))
        self._link, self._but, self._self, self._modal = (set(symbols.chars(n)) for n in ("LINK", "BUT", "SELF", "MODAL"))

    def governed(self, s: str) -> tuple[bytearray, bytearray]:
        """For each symbol: is it denied, and is it reported? One pass of two finite-state transducers, and one over quotations."""
        denied, reported = bytearray(len(s)), bytearray(len(s))
        no = told = False
        source = -99  # place of the last source of speech
        own = -99  # place of the last word for the writer
        start = 0
        quotes: list[int] = []
        speech = False
        for i, c in enumerate(s):
            if c in (STOP, BREAK):
                self._quoted(reported, quotes, speech)
                no = told = speech = False
                source = own = -99
                quotes, start = [], i + 1
                continue
            if c in (COMMA, COLON):
                if not (i + 1 < len(s) and s[i + 1] in self._link):
                    no = False
                if c == COLON and source >= start:
                    told = True
            elif c == QUOTE:
                quotes.append(i)
                if source >= start:
                    told = True
            else:
                if c in self._but:
                    no = False
                if c in self._self:
                    own = i
                if c in self._call:
                    speech = True
                    if i - own > 2 or no:
                        told, source = True, i
                    elif not told:
                        source = -99
                if c in self._case:
                    source, speech = i, True
                if c in self._link and 0 <= i - source <= 6:
                    told = True
                if c in self._modal and c not in self._call and c not in self._case and i - source <= 2 and not told:
                    source = -99
                if c in self._neg and c not in self._notneg:
                    no = True
            denied[i], reported[i] = no, told
        self._quoted(reported, quotes, speech)
        return denied, reported

    @staticmethod
    def _quoted(reported: bytearray, quotes: list[int], speech: bool) -> None:
        if speech:
            for a, b in zip(quotes[::2], quotes[1::2]):
                reported[a : b + 1] = b"\1" * (b + 1 - a)

    def scores(self, s: str) -> dict[str, float]:
        """Best weight of each category in a string of symbols."""
        best: dict[str, float] = {}
        states: tuple[bytearray, bytearray] | None = None
        passives: list[int] | None = None
        for category, weight, path, quick, free in self.paths:
            if best.get(category, 0.0) >= weight or not quick.match(s):
                continue
            at = 0
            while m := path.search(s, at):
                if states is None:
                    states = self.governed(s)
                denied, reported = states
                a, b = m.start(), m.end() - 1
                while b > a and s[b] in (COMMA, QUOTE, OTHER):
                    b -= 1
                # a denial at the end of a path is part of what it denies only if it stood before
                off = (denied[b] or reported[b]) and not free
                if not off and not free:
                    if passives is None:
                        passives = [i for i, c in enumerate(s) if c in self._call or (c in self._neg and c not in self._notneg)]
                    off = self._followed(s, b, passives)
                got = weight * DAMPING if off else weight
                if got > best.get(category, 0.0):
                    best[category] = got
                if not off:
                    break
                at = m.start() + 1
        return best

    def _followed(self, s: str, b: int, after: list[int]) -> bool:
        """Does a verb of speech stand at the end of the clause (as in a German or passive one), or a denial right behind?"""
        i = bisect_left(after, b + 1)
        if i == len(after) or after[i] - b > 3:
            return False
        between = s[b + 1 : after[i] + 1]
        if any(c in (COMMA, STOP, BREAK, COLON, QUOTE) or c in self._but for c in between):
            return False
        if s[after[i]] in self._call:
            # the end of its clause: what follows it is no object
            return after[i] + 1 >= len(s) or s[after[i] + 1] in (COMMA, STOP, BREAK) or (after[i] + 2 < len(s) and s[after[i] + 2] in (COMMA, STOP, BREAK))
        return after[i] == b + 1 and (after[i] + 1 >= len(s) or s[after[i] + 1] in (COMMA, STOP, BREAK))


@lru_cache(1)
def classes() -> dict[str, frozenset[str]]:
    """All surfaces of the lexicon, in every form, with their classes."""
    from quernstone.llm import inflect

    out: dict[str, set[str]] = {}
    for name, block in lexicon.CLASSES.items():
        for language, kind, words in lexicon.lines(block):
            for w in words:
                for f in inflect.forms(language, kind, w):
                    out.setdefault(f, set()).add(name)
    return {w: frozenset(k) for w, k in out.items()}
