"""SQL that the text queries must agree with, where SQL can say it."""

from __future__ import annotations

import unicodedata

from quernstone.llm.visible import BLANKS, HYPHENS, INVISIBLE, LOOK_ALIKES


def _looks() -> list[tuple[str, str]]:
    """Each character that is written otherwise in a form, and how, with accents apart: straight from the Unicode database."""
    same = {a: b for many, few in LOOK_ALIKES.values() for a, b in zip(many, few)} | dict.fromkeys(HYPHENS, "-") | dict.fromkeys(BLANKS, " ")
    gone = {chr(c) for a, b in INVISIBLE for c in range(a, b + 1)}
    out = []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE1000))):
        if "\uac00" <= c <= "\ud7a3":  # syllables that the final composition gives back
            continue
        if c in gone or c in same:
            plain = same.get(c, "")
        else:
            plain = "".join("" if x in gone else same.get(x, x) for x in unicodedata.normalize("NFKD", c))
        if plain != c:
            out.append((c, plain))
    return out


def _forms(name: str, source: str) -> str:
    """The form of each row of a source, as a named sub-query: one row a character, joined with its look, put together and composed."""
    return f"""{name} AS (SELECT s.id, any_value(s.txt) AS txt, CASE WHEN any_value(s.txt) IS NULL THEN NULL ELSE nfc_normalize(coalesce(string_agg(coalesce(looks.plain, k.c), '' ORDER BY k.i), '')) END AS form
        FROM ({source}) s LEFT JOIN (SELECT id, unnest(a) AS c, generate_subscripts(a, 1) AS i FROM (SELECT id, regexp_extract_all(txt, '(?s).') AS a FROM ({source}))) k ON k.id = s.id LEFT JOIN looks ON looks.c = k.c GROUP BY s.id)"""


_LOOKS = "looks(c, plain) AS (VALUES " + ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in _looks()) + ")"


SQL = {
    "p1_found": """
        WITH spans AS (
            SELECT r.result_id, r.query_id, r.doc_id, r.piece_no, r.char_start, r.char_end, r.exact_excerpt, d.text, length(d.text) AS n
            FROM production_retrieval_results r LEFT JOIN documents d ON r.doc_id = d.doc_id),
        judged AS (
            SELECT *, coalesce(char_end - char_start <= 480 AND char_start >= 0 AND char_end >= char_start AND char_end <= n
                               AND substr(text, (char_start + 1)::INT, (char_end - char_start)::INT) = exact_excerpt, false) AS is_span,
                   substr(text, (char_end + 1)::INT, 1) AS following
            FROM spans),
        cut AS (
            SELECT result_id FROM judged
            WHERE is_span AND char_end < n
              AND NOT regexp_matches(exact_excerpt, '(?s)[。！？；\\n]$')
              AND NOT (regexp_matches(exact_excerpt, '(?s)[.!?]$') AND following IN (' ', chr(13), chr(10)))
              AND (regexp_matches(substr(exact_excerpt, 241, length(exact_excerpt) - 241), '[。！？；\\n]')
                   OR regexp_matches(substr(exact_excerpt, 241), '[.!?][ \\r\\n]'))),
        torn AS (
            SELECT a.result_id FROM production_retrieval_results a JOIN production_retrieval_results b
              ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND a.piece_no = b.piece_no + 1
            GROUP BY a.result_id HAVING NOT coalesce(bool_or(a.char_start = b.char_end - 80), false))
        SELECT result_id FROM judged WHERE NOT is_span UNION SELECT result_id FROM cut UNION SELECT result_id FROM torn""",
    "p3_forms": f"WITH {_LOOKS}, {_forms('f', 'SELECT doc_id AS id, text AS txt FROM documents')} SELECT id AS doc_id, form FROM f",
    "p3_found": f"""WITH {_LOOKS}, {_forms('d', 'SELECT doc_id AS id, text AS txt FROM documents WHERE text IS NOT NULL')}, {_forms('t', 'SELECT theme_row_id AS id, title AS txt FROM theme_documents')},
        {_forms('c', 'SELECT title_id AS id, title AS txt FROM title_catalog')}
        SELECT 'documents' AS tbl, a.id AS key_a, b.id AS key_b FROM d a JOIN d b ON a.form = b.form AND a.txt <> b.txt AND a.id < b.id WHERE regexp_matches(a.form, '[^\\s]')
        UNION ALL SELECT 'theme_documents', c.id, t.id FROM c JOIN t ON c.form = t.form AND c.txt <> t.txt WHERE regexp_matches(c.form, '[^\\s]')""",
}
