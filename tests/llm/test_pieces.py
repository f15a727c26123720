import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import pieces


def natural(text, p):
    """Is the place p right after a natural boundary?"""
    return text[p - 1] in "。！？；\n" or (text[p - 1] in ".!?" and p < len(text) and text[p] in " \r\n")


def check(text, cuts, limit=480, overlap=80, least=240):
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b), (c, _) in zip(cuts, cuts[1:]):
        assert c == b - overlap
    for a, b in cuts:
        assert 0 < b - a <= limit
        if b < len(text):
            window = [p for p in range(a + least + 1, a + limit + 1)]
            places = [p for p in window if natural(text, p)]
            assert b in window and (not places or b in places)
            # the strongest of the window, and the rightmost among equals
            s = pieces.strengths(pieces.code_points(text))
            key = [(s[p - 1], p) for p in window]
            assert b == max(key)[1]


def test_random_texts():
    r = random.Random(4)
    texts = ["".join(r.choices("ab 。.!\n；，é\U0001f600", weights=[30, 30, 10, 1, 2, 1, 1, 1, 3, 1, 1], k=r.randint(0, 3000))) for _ in range(60)]
    for t, c in zip(texts, pieces.cut(texts)):
        if t:
            check(t, c)
        else:
            assert c == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("a .。\n\r!", max_size=200), max_size=5))
def test_small_limits(texts):
    for t, c in zip(texts, pieces.cut(texts, limit=20, overlap=4, least=9)):
        if t:
            check(t, c, 20, 4, 9)


def test_chunks_do_not_matter(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choices("ab .\n", k=r.randint(0, 1500))) for _ in range(40)]
    whole = pieces.cut(texts)
    monkeypatch.setattr(pieces, "CHUNK_CHARS", 700)
    assert pieces.cut(texts) == whole


def test_no_boundary_at_all():
    assert pieces.cut(["x" * 1000])[0] == [(0, 480), (400, 880), (800, 1000)]
    # visible characters stay whole where no stronger cut exists
    t = "x" * 479 + "e\u0301" + "y" * 600
    assert pieces.cut([t])[0][0] == (0, 479)


def test_range_maximum():
    r = np.random.default_rng(0)
    s = r.integers(0, 8, 500)
    t = pieces.StrongestCut(s, 240)
    first = r.integers(1, 400, 200)
    last = first + r.integers(-1, 100, 200)
    strength, place = t.query(first, last)
    for f, l, q, p in zip(first, last, strength, place):
        want = max(((s[i - 1], i) for i in range(f, l + 1)), default=(0, 0))
        assert (q, p) == want


def test_frames(spark):
    df = spark.createDataFrame([(1, "a. " * 400, 5), (2, None, 5), (3, "", 5), (1, "a. " * 400, 5), (4, "\U00020bb7" * 500, 5)], "doc_id bigint, text string, piece_no int")
    rows = pieces.split_texts(df, "doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {1, 4}
    assert sum(r.doc_id == 1 for r in rows) == 2 * len(pieces.cut(["a. " * 400])[0])
    texts = {1: "a. " * 400, 4: "\U00020bb7" * 500}
    assert all(texts[r.doc_id][r.char_start : r.char_end] == r.piece for r in rows)
    assert pieces.split_texts(df.limit(0), "doc_id", "text").count() == 0


def brute(results, documents):
    text = dict(documents)
    out = set()
    for rid, q, d, n, a, b, x in results:
        t = text.get(d)
        if None in (a, b, x) or t is None or not (0 <= a <= b <= len(t)) or b - a > 480 or t[a:b] != x:
            out.add(rid)
            continue
        if b < len(t) and not natural(t, b) and any(natural(t, p) for p in range(a + 241, b)):
            out.add(rid)
        before = [r for r in results if r[1] == q and r[2] == d and n is not None and q is not None and r[3] is not None and r[3] == n - 1]
        if before and not any(r[5] is not None and a == r[5] - 80 for r in before):
            out.add(rid)
    return out


def test_improper_against_brute_force(spark):
    r = random.Random(7)
    documents = [(i, "".join(r.choices("ab .。\n", weights=[40, 40, 8, 1, 1, 1], k=r.randint(0, 2500)))) for i in range(12)] + [(50, None)]
    results, rid = [], 0
    for d, t in documents:
        for q in (1, 2, None):
            for n, (a, b) in enumerate(pieces.cut([t or ""])[0]):
                rid += 1
                roll = r.random()
                if roll < 0.1:
                    b = min(len(t), b + r.randint(0, 30))
                elif roll < 0.2:
                    b = max(a, b - r.randint(0, 300))
                elif roll < 0.25:
                    a += 1
                x = t[a:b] if roll < 0.9 else t[a:b][:-1] + "Z"
                results.append((rid, q, d, n, a, b, x))
                if roll > 0.95:
                    results.append((rid + 10_000, q, d, n, a, b, x))
    results += [(90_001, 1, 77, 0, 0, 1, "a"), (90_002, 1, 1, None, 0, 1, documents[1][1][:1]), (90_003, 1, 1, 0, None, 3, "abc"), (90_004, 1, 50, 0, 0, 0, "")]
    rf = spark.createDataFrame(results, "result_id bigint, query_id bigint, doc_id bigint, piece_no int, char_start bigint, char_end bigint, exact_excerpt string")
    df = spark.createDataFrame([(d, t, "other") for d, t in documents], "doc_id bigint, text string, query_id string")
    got = sorted(r.result_id for r in pieces.improper_pieces(rf, df).collect())
    assert got == sorted(brute(results, documents))
    assert pieces.improper_pieces(rf.limit(0), df).count() == 0
    assert pieces.improper_pieces(rf, df.limit(0)).count() == len({x[0] for x in results})
