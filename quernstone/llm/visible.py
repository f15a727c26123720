"""One consistent form for texts that look alike.

The form maps compatibility characters to their plain ones, drops invisible
characters, turns every kind of blank into a space, composes accents, and maps
letters and hyphens of equal shape to one of them. Case, accents, digits, words,
line breaks and every visible mark stay as they are. Letters of equal shape all
become Latin, so a Russian text keeps its words apart: two words have the same
form exactly if they look the same.

The work is done by DuckDB inside the Arrow partitions, as one SQL expression
of nfc_normalize, translate and regular expressions; its tables are built here
from the Unicode database by rule.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.session import settled, spill_folder

# Letters of equal shape, each list in the order of the Latin letters beside it.
LOOK_ALIKES = {
    "Cyrillic capitals": ("АВСЕНІЈКМОРԚЅТԜХУҮԌӀ", "ABCEHIJKMOPQSTWXYYGI"),
    "Cyrillic small": ("асԁеһіјорԛѕԝхуүѵӏ", "acdehijopqswxyyvl"),
    "Greek capitals": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"),
    "Greek small": ("νορϲϳ", "vopcj"),
    "Armenian": ("ՕՍօսհոց", "OUouhng"),
    "Cherokee": ("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᎡᎢᏙᎳᏃᏚᏀ", "ABCEHJKLMPRTVWZSG"),
    "Latin": ("ɑɡ", "ag"),
    # capitals that Cyrillic and Greek share with each other only
    "Greek for Cyrillic": ("ΓΠΦ", "ГПФ"),
}
HYPHENS = "‐‑"
#: Blanks other than the space; line ends and the tab are no blanks of a line.
BLANKS = "".join(map(chr, [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
#: Ranges of characters without any look of their own.
INVISIBLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF),
)
#: Blocks beyond the basic plane that hold compatibility characters.
_UPPER_BLOCKS = ((0x1D400, 0x1D800), (0x1EE00, 0x1EF00), (0x1F100, 0x1F300), (0x1FBF0, 0x1FBFA), (0x2F800, 0x2FA20))
#: Compatibility blocks common enough to be mapped in every text.
_COMMON = ((0xFF01, 0xFF5F),)


def _shape() -> dict[str, str]:
    shape = {a: b for look, latin in LOOK_ALIKES.values() for a, b in zip(look, latin, strict=True)}
    shape |= dict.fromkeys(HYPHENS, "-") | dict.fromkeys(BLANKS, " ")
    return shape


def _is_invisible(c: int) -> bool:
    return any(a <= c <= b for a, b in INVISIBLE)


@lru_cache(1)
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(common, rare, many): maps of one character to one, common and rare, and of one to several."""
    shape = _shape()
    common, rare, many = dict(shape), {}, {}
    blocks = [(0xA0, 0xD800), (0xF900, 0x10000), *_UPPER_BLOCKS]
    for c in (c for a, b in blocks for c in range(a, b)):
        ch = chr(c)
        if ch in shape or _is_invisible(c) or 0xAC00 <= c < 0xD7A4:
            continue
        plain = unicodedata.normalize("NFKC", ch)
        # look-alikes may hide under an accent
        apart = "".join("" if _is_invisible(ord(x)) else shape.get(x, x) for x in unicodedata.normalize("NFD", plain))
        to = unicodedata.normalize("NFC", apart)
        if to == ch:
            continue
        if len(to) != 1:
            many[ch] = to
        elif any(a <= c < b for a, b in _COMMON):
            common[ch] = to
        else:
            rare[ch] = to
    return common, rare, many


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _class(chars) -> str:
    """A regular expression class of the characters, as ranges."""
    points, out, i = sorted(map(ord, chars)), [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:x}}}" + (f"-\\x{{{points[j]:x}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(out) + "]"


def _invisible_class() -> str:
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in INVISIBLE) + "]"


@lru_cache(1)
def form_sql(column: str = "txt") -> str:
    """The form of each row of batch(id, column), as a query with the columns id, column and form.

    Order: characters that stand for several; rare, then common compatibility
    characters and look-alikes one for one; invisible characters away; accents
    composed. Before the last step all letters already have their final shape,
    so that an accent beside its letter and one within it end up the same.
    """
    common, rare, many = tables()
    often = [c for c in "…℃№ﬀﬁﬂﬃﬄ" if c in many]
    seldom = [c for c in many if c not in often]
    x = column
    for c in often:
        x = f"replace({x}, {_literal(c)}, {_literal(many[c])})"
    spelled = f"map([{', '.join(map(_literal, seldom))}], [{', '.join(_literal(many[c]) for c in seldom)}])"
    stages = [("s1", x)]
    stages.append(("s2", f"CASE WHEN regexp_matches(s1, {_literal(_class(seldom))}) THEN array_to_string(list_transform(regexp_extract_all(s1, '(?s).'), lambda c: coalesce({spelled}[c], c)), '') ELSE s1 END"))
    stages.append(("s3", f"CASE WHEN regexp_matches(s2, {_literal(_class(rare))}) THEN translate(s2, {_literal(''.join(rare))}, {_literal(''.join(rare.values()))}) ELSE s2 END"))
    stages.append(("s4", f"translate(s3, {_literal(''.join(common))}, {_literal(''.join(common.values()))})"))
    stages.append(("s5", f"CASE WHEN regexp_matches(s4, {_literal(_invisible_class())}) THEN regexp_replace(s4, {_literal(_invisible_class())}, '', 'g') ELSE s4 END"))
    stages.append(("form", "nfc_normalize(s5)"))
    source = f"SELECT id, {column} FROM batch"
    for name, sql in stages:
        source = f"SELECT id, {column}, {sql} AS {name} FROM ({source})"
    return source


_connection = None


def _duckdb():
    global _connection
    if _connection is None:
        import duckdb

        _connection = duckdb.connect(config={"threads": "1", "memory_limit": "384MB", "temp_directory": spill_folder()})
    return _connection


def _run(batches: Iterator[pa.RecordBatch], select: str) -> Iterator[pa.RecordBatch]:
    con = _duckdb()
    sql = f"SELECT {select} FROM ({form_sql()})"
    for b in batches:
        con.register("batch", pa.Table.from_batches([b.rename_columns(["id", "txt"])]))
        yield from con.sql(sql).to_arrow_table().to_batches()
        con.unregister("batch")


def forms(df: DataFrame, id_column: str, text_column: str, *, form_name: str = "form") -> DataFrame:
    """(id, form) of every row, without a shuffle; a null text has a null form, an empty one an empty form."""
    id_type = df.select(id_column).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _run(batches, "id, form"):
            yield b.rename_columns([id_column, form_name])

    return df.select(id_column, F.col(text_column).cast("string")).mapInArrow(run, f"`{id_column}` {id_type}, `{form_name}` string")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shown = "regexp_matches(form, '[^\\s]')"
    wanted = pa.schema([("id", pa.int64()), ("form_key", pa.binary()), ("text_key", pa.binary())])
    for b in _run(batches, f"id, CASE WHEN {shown} THEN unhex(md5(form)) END AS form_key, unhex(md5(txt)) AS text_key"):
        yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, wanted.types)], schema=wanted)


def form_keys(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, form_key, text_key): 128-bit digests of form and text of the rows that show anything at all."""
    narrow = df.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string"))
    return narrow.mapInArrow(_keys, "id bigint, form_key binary, text_key binary").where("form_key is not null")


def alike_pairs(keys: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b: rows of equal form whose texts differ.

    Rows of equal text form one class. Only forms with more than one class go
    on; classes meet once, and their members are joined to the pairs of
    classes, so that exact copies never meet each other.
    """
    keys = settled(keys)
    mixed = keys.groupBy("form_key").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi").select("form_key")
    rows = keys.join(mixed, "form_key")
    classes = rows.select("form_key", "text_key").distinct()
    a, b = (classes.select("form_key", F.col("text_key").alias(t)) for t in ("ta", "tb"))
    pairs = a.join(b, "form_key").where("ta < tb")
    both = pairs.join(rows.select("form_key", F.col("text_key").alias("ta"), F.col("id").alias("ia")), ["form_key", "ta"]).join(
        rows.select("form_key", F.col("text_key").alias("tb"), F.col("id").alias("ib")), ["form_key", "tb"])
    return both.select(F.least("ia", "ib").alias("key_a"), F.greatest("ia", "ib").alias("key_b")).where("key_a < key_b")


def alike_titles(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key_a, key_b): ids of catalog titles, and of rows that look the same but are written differently."""
    c = catalog.select(F.col("id").alias("key_a"), "form_key", F.col("text_key").alias("catalog_text"))
    return rows.join(c, "form_key").where("text_key <> catalog_text").select("key_a", F.col("id").alias("key_b"))
