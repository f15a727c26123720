"""Text helpers built from Spark's own expressions, and one Arrow function for what they lack."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "㐀-䶿一-鿿"


def fold(text: Column) -> Column:
    """Lower case with ß as ss, blanks of every kind collapsed to one space, trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


def normal(text: str) -> str:
    """NFKC, then full case folding, blanks collapsed and trimmed: full-width letters, ligatures and the like become plain ones."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def norm(text: Column) -> Column:
    """normal() of a column."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else normal(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of a text in lower case, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1))


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring CJK characters; a run of one character gives that character.

    One look-ahead at every place finds overlapping pairs in a single pass.
    """
    return F.regexp_extract_all(text, F.lit(f"(?=([{CJK}]{{2}}|(?<![{CJK}])[{CJK}](?![{CJK}])))"), F.lit(1))


def terms(text: Column) -> Column:
    """Words and CJK bigrams of a text. Their characters differ, so the two kinds never meet."""
    t = F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
    return F.concat(words(t), bigrams(t))


def has_terms(text: Column) -> Column:
    """Has a text any term? Without making them."""
    return F.coalesce(F.lower(text).rlike(f"[a-z0-9ß{CJK}]"), F.lit(False))


def fixed_chunks(text: Column, size: int = 480, overlap: int = 80) -> Column:
    """array<struct<chunk_no, char_start, chunk>> of windows of equal size; the last may be short, blank ones are left out."""
    n, step = F.length(text), size - overlap
    count = F.greatest(F.ceil((n - overlap) / F.lit(step)), F.lit(1)).cast("int")
    all_ = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk_no"), (i * step).alias("char_start"), F.substring(text, i * step + 1, F.lit(size)).alias("chunk")))
    return F.when(n > 0, F.filter(all_, lambda c: F.trim(c["chunk"]) != ""))


def excerpt(text: Column, position: Column, *, before: int = 250, size: int = 1000) -> Column:
    """At most `size` characters around a zero-based position, an ellipsis where something is left out.

    A text within the size is whole; near the end of a longer one the window
    moves back until it is filled. A null position counts as the start.
    """
    start = F.greatest(F.least(F.coalesce(position, F.lit(0)) - before, F.length(text) - size), F.lit(0))
    body = F.substring(text, (start + 1).cast("int"), F.lit(size))
    return F.concat(F.when(start > 0, "…").otherwise(""), body, F.when(start + size < F.length(text), "…").otherwise(""))


def csv_safe(text: Column) -> Column:
    """A text that a spreadsheet does not read as a formula; null becomes empty."""
    return F.when(text.isNull(), "").when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def compact(text: Column) -> Column:
    """text without any blanks, for comparisons across line breaks."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def visible_html(html: Column) -> Column:
    """What a page shows: no scripts, styles, comments or tags; the basic entities spelled out."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def url_ok(url: Column, *, allow_user: bool = True) -> Column:
    """Has the address an http or https scheme and a host, and if asked, no user part? Null is no address."""
    form = r"^(?i:https?)://[^\s/?#@]+(?:[/?#]\S*)?$" if not allow_user else r"^(?i:https?)://[^\s/?#]+(?:[/?#]\S*)?$"
    return F.coalesce(url.rlike(form), F.lit(False))


def strict_https(url: Column) -> Column:
    """An https address on the standard port, of a public host by name, without user, fragment or blanks."""
    host = F.lower(F.regexp_extract(url, r"^https://([^/?#]+)", 1))
    name = F.regexp_replace(host, r":443$", "")
    shaped = name.rlike(r"^(?=.{1,253}$)([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]([a-z0-9-]{0,61}[a-z0-9])?$")
    private = name.rlike(r"(^|\.)(localhost|local|internal|invalid|test|example|onion|home\.arpa)$")
    return F.coalesce(url.rlike(r"^https://[^\s#@\\]+$") & shaped & ~private, F.lit(False))
