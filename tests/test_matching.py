"""Matching text, query expansion and fixed chunks, by hand and by brute force."""

import datetime
import math
import re

import pytest
from pyspark.sql import functions as F

from quernstone.functions import dates, matching, text
from quernstone.operators import chunks

DICTIONARY = {"robots": ["robot", "机器人", "Robotics"], "fibre": ["optical fibre", "光纤"]}


def test_matching_text_maps_back():
    for t in ["", "Plain ASCII", "ＡＢＣ ﬁne", "机器\n 人 a", "Straße ㎏", "é é Ⅷ", "  x　y "]:
        shown, places = matching.matching_text(t)
        assert len(shown) == len(places) and (not len(places) or (list(places) == sorted(places) and places[-1] < len(t)))
    shown, places = matching.matching_text("新型机器\n 人ﬁn")
    assert shown == "新型机器人fin" and places.tolist() == [0, 1, 2, 3, 6, 7, 7, 8]
    m = re.search("机器人", shown)
    assert "新型机器\n 人ﬁn"[places[m.start()] : places[m.end() - 1] + 1] == "机器\n 人"


def test_columns(spark):
    df = spark.createDataFrame([("机器 人 A",), (None,), ("",)], "t string")
    got = df.select(matching.analysis_text(F.col("t")).alias("a"), matching.matched(F.col("t")).alias("m")).collect()
    assert [r.a for r in got] == ["机器人 A", None, ""] and got[0].m.shown == "机器人 a" and got[1].m is None and got[2].m.shown == ""


def test_terms_of_a_query(spark):
    assert matching.expand("industrial ROBOT arms", DICTIONARY) == (["industrial ROBOT arms", "robot", "Robotics", "robots", "机器人"], ["robots"])
    assert matching.expand("robotic", DICTIONARY) == (["robotic"], []) and matching.expand("光纤机器人", DICTIONARY)[1] == ["fibre", "robots"]
    assert matching.qualifiers("the XK-200 and ＸＫ３ at 5 mm, GPT4.1") == ["gpt4.1", "xk-200", "xk3"] and matching.qualifiers("plain words 12") == []
    hits = lambda term, t: bool(re.search(matching.term_pattern(term), t, re.I)) == spark.createDataFrame([(t,)], "t string").select(F.col("t").rlike("(?i)" + matching.term_pattern(term))).first()[0] and bool(re.search(matching.term_pattern(term), t, re.I))
    assert hits("optical fibre", "an Optical \n fibre.") and not hits("robot", "robots") and hits("a.b", "x a.b") and not hits("a.b", "x axb") and hits("机器人", "a机器人b") and hits("c++", "c++ code")


def test_chunk_scores_against_brute_force(spark):
    docs = [(1, "A", "The robot arm XK-200 lifts."), (2, "A", "THE robot arm xk-200 lifts."), (3, "B", "The robot arm XK-200 lifts."), (4, "B", "机器人 fibre"), (5, "C", "nothing here"), (6, None, "robot"), (7, "C", None), (8, "C", "robot XK-2000")]
    df = spark.createDataFrame(docs, "d bigint, g string, t string")
    found = chunks.chunks(df, "d", "t", "g")
    assert found.count() == 6 and found.select("unit").distinct().count() == 5
    asked = spark.createDataFrame([(1, "robot"), (2, "robot XK-200")], "q bigint, s string")
    got = {(r.q, r.chunk_id): (round(r.bm25_score, 9), r.bm25_rank) for r in chunks.bm25_chunks(found, asked, "q", "s", DICTIONARY, k=10).collect()}
    assert {k for k in got if k[0] == 2} == {(2, "1#0"), (2, "2#0"), (2, "3#0")}  # XK-2000 is another model
    assert {k[1] for k in got if k[0] == 1} == {"1#0", "2#0", "3#0", "4#0", "8#0"} and got[1, "1#0"][0] == got[1, "2#0"][0] == got[1, "3#0"][0]
    toks = lambda t: re.findall("[a-z0-9]+", t) + [w[i : i + 2] for w in re.findall("[㐀-鿿]+", t) for i in range(len(w) - 1)]
    units = [toks(t) for t in {("A", "the robot arm xk-200 lifts."), ("B", "the robot arm xk-200 lifts."), ("B", "机器人 fibre"), ("C", "nothing here"), ("C", "robot xk-2000")} for t in [t[1]]]
    mean = sum(map(len, units)) / len(units)
    words = set(toks(text.normal(" ".join(matching.expand("robot", DICTIONARY)[0]))))

    def score(u):
        total = 0
        for w in words & set(u):
            df_ = sum(w in x for x in units)
            total += math.log(1 + (len(units) - df_ + 0.5) / (df_ + 0.5)) * u.count(w) * 2.5 / (u.count(w) + 1.5 * (0.25 + 0.75 * len(u) / mean))
        return round(total, 9)

    assert got[1, "1#0"][0] == pytest.approx(score(toks("the robot arm xk-200 lifts.")), abs=1e-8) and got[1, "4#0"][0] == pytest.approx(score(toks("机器人 fibre")), abs=1e-8)


def test_four_scores(spark):
    found = spark.createDataFrame([("a", 1, "x", "u"), ("b", 1, "y", "v"), ("c", 2, "z", "w")], "chunk_id string, d bigint, shown string, unit string")
    bm = spark.createDataFrame([(1, "a", 3.0, 1), (1, "b", 2.0, 2)], "q bigint, chunk_id string, bm25_score double, bm25_rank int")
    de = spark.createDataFrame([(1, "b", 0.9, 1), (1, "c", 0.8, 2)], "q bigint, chunk_id string, dense_cosine double, dense_rank int")
    got = [(r.chunk_id, r.rank, r.d, r.bm25_score, r.dense_cosine, round(r.rrf_score, 6), r.reranker_score) for r in chunks.four_scores(found, bm, de, None, "q", k=2).orderBy("rank").collect()]
    assert got == [("b", 1, 1, 2.0, 0.9, round(1 / 62 + 1 / 61, 6), None), ("a", 2, 1, 3.0, None, round(1 / 61, 6), None)]
    rr = spark.createDataFrame([(1, "a", 5.0), (1, "c", 7.0)], "q bigint, chunk_id string, reranker_score double")
    assert [r.chunk_id for r in chunks.four_scores(found, bm, de, rr, "q", k=5).orderBy("rank").collect()] == ["c", "a"]


def test_stamps_and_windows(spark):
    rows = ["31/12/2023 23:59", "31/02/2023 10:00", "1/1/2023 10:00", "2023-01-01 10:00", None, "31/12/2023 24:61"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(dates.stamp_of(F.col("t"))).collect()]
    assert got == [datetime.datetime(2023, 12, 31, 23, 59)] + [None] * 5
    got = [r[0] for r in spark.createDataFrame([("List (Updated as at 05/03/2024)",), ("updated as at 31/02/2024",), ("x",), (None,)], "t string").select(dates.updated_as_at(F.col("t"))).collect()]
    assert got == [datetime.date(2024, 3, 5), None, None, None]
    d = datetime.date
    full = {d(2024, 1, 1 + i): n for i, n in enumerate([3, 0, 5, 1, 1, 9])}
    count = lambda a, b: sum(n for day, n in full.items() if a <= day <= b)
    parts = dates.halves(d(2024, 1, 1), d(2024, 1, 6), lambda a, b: count(a, b) > 9)
    assert parts[0][0] == d(2024, 1, 1) and parts[-1][1] == d(2024, 1, 6) and all(y[0] == x[1] + datetime.timedelta(1) for x, y in zip(parts, parts[1:])) and all(count(*p) <= 9 for p in parts)
    with pytest.raises(ValueError):
        dates.halves(d(2024, 1, 1), d(2024, 1, 6), lambda a, b: count(a, b) > 8)


def test_strict_https(spark):
    urls = ["https://a.org/x?y=1", "https://a.org:443/", "http://a.org/", "https://a.org:8443/", "https://u@a.org/", "https://a.org/#f", "https://localhost/", "https://10.0.0.1/", "https://x.internal/", "https://a_b.org/", "https://a.org/ b", None, "https://[::1]/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(text.strict_https(F.col("u"))).collect()]
    assert got == [True, True] + [False] * 11
