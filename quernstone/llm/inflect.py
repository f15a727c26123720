"""Forms of a word, by rule: endings of nouns, adjectives and verbs, by language.

The rules make too many forms rather than too few: one that no speaker would
write does no harm in a list of words to look for.
"""

from __future__ import annotations

#: The endings that a stem may take.
NOUN = {
    "fr": ("", "s", "e", "es", "x"),
    "de": ("", "e", "en", "er", "n", "s", "es", "ern", "in", "innen"),
    "ru": ("", "а", "я", "у", "ю", "ом", "ем", "ой", "ей", "е", "ы", "и", "ов", "ев", "ам", "ям", "ами", "ями", "ах", "ях", "ь", "ью", "ья", "ьи", "о", "ёй", "и́"),
    "es": ("", "a", "o", "as", "os", "e", "es", "s"),
    "it": ("", "a", "o", "e", "i", "hi", "he", "io", "ia", "ie"),
}
ADJECTIVE = {
    "de": ("", "e", "en", "er", "es", "em", "ste", "sten"),
    "ru": ("", "ый", "ий", "ой", "ая", "яя", "ое", "ее", "ые", "ие", "ого", "его", "ому", "ему", "ым", "им", "ую", "ых", "их", "ыми", "ими", "ом", "ем", "а", "о", "ы", "и"),
}
FRENCH_VERB = ("er", "e", "es", "ons", "ez", "ent", "é", "ée", "és", "ées", "ant", "erai", "eras", "era", "erons", "erez", "eront", "erait", "ait", "aient", "ais")


def _english_verb(word: str) -> set[str]:
    base, _, rest = word.partition(" ")
    stem = base[:-1] if base.endswith("e") else base
    double = base + base[-1] if len(base) > 2 and base[-1] in "bdgmnpt" and base[-2] in "aiou" and base[-3] not in "aeiou" else None
    third = base + ("es" if base.endswith(("s", "sh", "ch", "x")) else "s")
    # the past is for reports; what threatens stands in the present
    forms = {base, third, (double or stem) + "ing"}
    return {f"{f} {rest}" if rest else f for f in forms}


def forms(language: str, kind: str, word: str) -> set[str]:
    """All forms of a word of a list; of Russian ё also the spelling with е."""
    if kind == "x":
        out = {word}
    elif language == "en" and kind == "n":
        plural = word[:-1] + "ies" if word.endswith("y") and word[-2:-1] not in "aeiou" else word + ("es" if word.endswith(("s", "x", "ch", "sh")) else "s")
        if " of " in word:  # pieces of shit
            first, _, rest = word.partition(" ")
            plural = f"{first}s {rest}"
        out = {word, plural, word + "s"}  # and as it is often misspelt
    elif language == "en" and kind == "v":
        out = _english_verb(word)
    elif kind == "v":
        soft = word[:-1] + "ç" if word.endswith("c") else word  # ç before a
        out = {(soft if e.startswith("a") else word) + e for e in FRENCH_VERB}
    else:
        stem = word[:-1] if kind == "a" and word.endswith("e") else word
        out = {word} | {stem + e for e in (ADJECTIVE if kind == "a" else NOUN).get(language, ("",))}
        if language in ("es", "it") and word[-1] not in "aeiouéllnr":
            out.discard(word)  # a bare stem, and perhaps a word of another language
    return out | {w.replace("ё", "е") for w in out if "ё" in w}
