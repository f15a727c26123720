import pytest
from compare import spark_rows, sql_rows, views

from quernstone.llm import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_agrees_with_sql(spark, sf, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf)) == sql_rows(views(sf), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def _texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def _natural(t, p):
    return t[p - 1] in "。！？；\n" or (t[p - 1] in ".!?" and p < len(t) and t[p] in " \r\n")


def test_pieces_hold_every_text_whole(spark, sf):
    texts, pieces = _texts(spark, sf), {}
    for r in catalogue.QUERIES["p1_pieces"](spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {i for i, t in texts.items() if t}
    for i, ps in pieces.items():
        ps.sort(key=lambda r: r.piece_no)
        t = texts[i]
        assert [p.piece_no for p in ps] == list(range(len(ps))) and ps[0].char_start == 0 and ps[-1].char_end == len(t)
        assert all(b.char_start == a.char_end - 80 for a, b in zip(ps, ps[1:]))
        for p in ps:
            assert p.piece == t[p.char_start : p.char_end] and 0 < len(p.piece) <= 480
            held = [q for q in range(p.char_start + 241, p.char_end) if _natural(t, q)]
            assert p.char_end == len(t) or _natural(t, p.char_end) or not held


def test_containers_hold_every_text(spark, sf):
    need = {r.doc_id: len(r.ids) for r in catalogue.QUERIES["p6_ids"](spark, sf).collect()}
    filled, of = {}, {}
    for r in catalogue.QUERIES["p7_containers"](spark, sf).collect():
        filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
        of.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.token_end))
    assert set(of) == set(need) and max(filled.values()) <= 2048 and sum(filled.values()) == sum(need.values())
    for i, ps in of.items():
        ps.sort()
        assert ps[0][1] == 0 and ps[-1][2] == need[i] and all(a[2] == b[1] for a, b in zip(ps, ps[1:])) and (len(ps) == 1 or need[i] > 2048)
    gaps = catalogue.QUERIES["p7_gaps"](spark, sf).collect()
    assert sum(g.containers for g in gaps) == sum(n > 0 for n in filled.values()) and all(0 <= g.gap <= 1 for g in gaps)


def test_scores_and_rates_agree(spark, sf):
    scored = catalogue.QUERIES["p8_scores"](spark, sf).collect()
    assert all(r.score == max(r.insult, r.threat, r.hate, r.sexual) and (r.category is None) == (r.score == 0) for r in scored)
    assert {r.doc_id for r in scored if r.score >= 0.5} == {r.doc_id for r in catalogue.QUERIES["p8_found"](spark, sf).collect()}
    want = {}
    for r in scored:
        n, bad = want.get(r.source, (0, 0))
        want[r.source] = n + 1, bad + (r.score >= 0.5)
    assert {r.source: (r.texts, r.unwelcome) for r in catalogue.QUERIES["p8_source_rates"](spark, sf).collect()} == want
