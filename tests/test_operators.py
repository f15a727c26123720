"""Hand-made cases and brute force for the relational operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import numeric, sentences, text
from quernstone.operators import anomaly, coverage, evaluation, lexical, peers, ranks, vectors, versions


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


# -- numbers ------------------------------------------------------------------

@pytest.mark.parametrize(("raw", "want"), [("1.5", 1.5), (" 2 ", 2.0), ("-3e2", -300.0), ("NA", None), ("", None), (None, None), ("NaN", None), ("1e400", None), ("12d", None), ("1_000", None), ("0x1", None), ("+.5", 0.5)])
def test_number(spark, raw, want):
    assert one(spark, raw, "string", numeric.number) == want


def test_null_safe_arithmetic(spark):
    df = spark.createDataFrame([(6.0, 3.0), (1.0, 0.0), (1.0, -2.0), (None, 2.0), (1e308, 1e-308)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    assert [r[0] for r in df.select(numeric.divide(a, b)).collect()] == [2.0, None, None, None, None]
    assert [r[0] for r in df.select(numeric.divide(a, b, positive=False)).collect()] == [2.0, None, -0.5, None, None]
    x = spark.createDataFrame([(160.0, 100.0), (0.0, 1.0), (None, 1.0), (1.0, -1.0)], "a double, b double").select(numeric.cagr(a, b), numeric.growth(a, b), numeric.average(a, b)).collect()
    assert math.isclose(x[0][0], math.sqrt(1.6) - 1) and x[1][0] is None and x[2][0] is None and x[3][0] is None
    assert math.isclose(x[0][1], 0.6) and x[0][2] == 130.0
    big = spark.createDataFrame([(1.7e308, 1.7e308)], "a double, b double").select(numeric.average(a, b), numeric.difference(a, -b)).first()
    assert big[0] == 1.7e308 and big[1] is None
    keys = spark.createDataFrame([(1.0,), (1.0 + 2e-16,), (1.000001,), (None,)], "x double").select(numeric.rank_key("x")).collect()
    assert keys[0] == keys[1] != keys[2] and keys[3][0] is None


# -- ranks --------------------------------------------------------------------

def midrank(values, higher=True, least=1):
    out = []
    known = [v for v in values if v is not None]
    for v in values:
        if v is None or len(known) < least:
            out.append(None)
        elif len(set(known)) == 1:
            out.append(50.0)
        else:
            p = (sum(w < v for w in known) + (sum(w == v for w in known) - 1) / 2) / (len(known) - 1) * 100
            out.append(p if higher else 100 - p)
    return out


def test_midranks(spark):
    r = random.Random(8)
    rows, want = [], {}
    for g in ("a", None, "b", "c"):
        vs = {"a": [1.0, 2.0, 2.0, 4.0], None: [r.choice([1.0, 2.0, 3.0, None]) for _ in range(300)], "b": [7.0] * 6, "c": [5.0]}[g]
        for v, p, q in zip(vs, midrank(vs), midrank(vs, False)):
            want[len(rows)] = (p, q)
            rows.append((len(rows), g, v, v, "extra"))
    df = spark.createDataFrame(rows, "k bigint, g string, up double, down double, value string")
    got = {x.k: (x.up_pct, x.down_pct) for x in ranks.midranks(df, "k", ["g"], {"up": True, "down": False}, least=1).collect()}
    assert got == want and got[1] == (50.0, 50.0) and got[3] == (100.0, 0.0)
    few = ranks.midranks(df.where("g = 'a'"), "k", ["g"], {"up": True}, least=5)
    assert {x.up_pct for x in few.collect()} == {None}
    assert ranks.midranks(df.limit(0), "k", ["g"], {"up": True}).count() == 0


def test_quantiles(spark):
    r = np.random.default_rng(1)
    groups = {"a": r.normal(size=500), "b": np.repeat([1.0, 5.0], 50), "c": np.array([3.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs] + [("d", None), ("a", None)], "g string, v double")
    got = {x["__g"]: (x.v_q, x.v_n) for x in ranks.quantiles(df, ["g"], ["v"], (0.0, 0.1, 0.5, 0.95, 1.0)).collect()}
    assert len(got) == 3
    for g, vs in groups.items():
        q, n = got['{"g":"%s"}' % g]
        assert n == len(vs) and np.allclose(q, np.quantile(vs, (0.0, 0.1, 0.5, 0.95, 1.0)))


def test_outliers_and_blocks(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 5, 100)] + [("h", 1.0)] * 6 + [("g", None)], "g string, v double")
    got = peers.mad_outlier(df, ["g"], "v").collect()
    assert {x.v for x in got if x.v_outlier} == {100.0} and {x.v_outlier for x in got if x.g == "h"} == {None} and len(got) == 13
    b = spark.createDataFrame([(40.0, 60.0, None)], "a double, b double, c double").select(peers.block("a", "b"), peers.block("a", "c"), peers.composite({"a": 0.5, "b": 0.5, "c": 0.0}), peers.composite({"a": 0.5, "c": 0.5})).first()
    assert tuple(b) == (50.0, None, 50.0, None)


# -- versions -----------------------------------------------------------------

def test_versions(spark):
    df = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 0, "y"), ("a", 2, 0, "y"), ("b", 1, 0, "p"), ("b", 1, 0, "q"), ("c", 1, None, None)], "k string, pub int, rev int, v string")
    got = {x.k: x.v for x in versions.latest(df, ["k"], [F.col("pub"), F.col("rev"), F.col("v")], ["v"]).collect()}
    assert got == {"a": "y", "b": "q", "c": None}
    assert [(x.k, x.versions) for x in versions.conflicts(df, ["k", "pub", "rev"], ["v"]).collect()] == [("b", 2)]
    assert {(x.k, x.v): x.copies for x in versions.first_seen(df, ["k", "v"], [F.col("pub")], ["rev"]).collect()}[("a", "y")] == 2
    p = versions.with_previous(df.where("k = 'a'").distinct(), ["k"], "pub", ["v"]).orderBy("pub").collect()
    assert [(x.v, x.v_1, x.v_2) for x in p] == [("x", None, None), ("y", "x", None)]


# -- retrieval ----------------------------------------------------------------

def test_bm25_against_hand(spark):
    docs = spark.createDataFrame([(1, "robot arm"), (2, "robot robot"), (3, "机器人手臂"), (4, None), (5, "")], "d bigint, t string")
    asked = spark.createDataFrame([(1, "robot ROBOT"), (2, "机器")], "q bigint, s string")
    got = {(x.q, x.d): x.score for x in lexical.bm25(docs, "d", "t", asked, "q", "s").collect()}
    n, mean = 5, (2 + 2 + 4) / 5
    idf = math.log(1 + (n - 2 + 0.5) / 2.5)
    want = {d: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 2 / mean)) for d, tf in ((1, 1), (2, 2))}
    assert math.isclose(got[(1, 1)], want[1]) and math.isclose(got[(1, 2)], want[2]) and (2, 3) in got and len(got) == 3


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(30)]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 2)):
            other = list(base)
            for _ in range(r.choice([0, 1, 2, 6])):
                other[r.randrange(30)] = r.choice(vocabulary)
            texts.append(" ".join(other))
    rows = [(i, r.choice(["A", "A", "B", None]), t, i % 7) for i, t in enumerate(texts)] + [(500, "A", None, 0), (501, "A", "", 0), (502, "A", "", 0)]
    df = spark.createDataFrame(rows, "d bigint, g string, t string, day int")
    for threshold in (0.9, 0.7):
        got = {x.d: (x.match, round(x.similarity, 6)) for x in lexical.near_duplicates(df, "d", "t", "g", ["day"], threshold=threshold).collect()}
        docs = [x for x in rows if x[1] is not None]
        bags = {i: {w: t.split().count(w) for w in set(t.split())} if t else {} for i, g, t, _ in docs}
        n = len(docs)
        freq = {w: sum(w in b for b in bags.values()) for w in vocabulary}
        vec = {}
        for i, b in bags.items():
            v = {w: (1 + math.log(c)) * (math.log((1 + n) / (1 + freq[w])) + 1) for w, c in b.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            vec[i] = {w: x / norm for w, x in v.items()}
        want = {}
        for i, g, _, day in docs:
            near = [(-round(min(1.0, sum(x * vec[j].get(w, 0) for w, x in vec[i].items())), 9), dj, j) for j, gj, _, dj in docs if gj == g and (dj, j) < (day, i) and vec[i] and vec[j]]
            near = [x for x in near if -x[0] >= threshold]
            if near:
                want[i] = (min(near)[2], round(-min(near)[0], 6))
        assert got == want and len(want) > 5


def test_cosine_against_numpy(spark):
    r = np.random.default_rng(2)
    m = r.normal(size=(300, 8)).astype(np.float32)
    m[7] = m[3]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [])]
    v = spark.createDataFrame(rows, "i bigint, e array<float>").repartition(3)
    q = v.where("i % 50 = 0 or i > 899").selectExpr("i as q", "e as a")
    got = {}
    for x in vectors.cosine_topk(v, "i", "e", q, "q", "a", k=5).collect():
        got.setdefault(x.q, []).append((x["rank"], x.i))
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    for k in range(0, 300, 50):
        s = np.round(unit @ unit[k], 12)
        assert [i for _, i in sorted(got[k])] == sorted(range(300), key=lambda i: (-s[i], i))[:5]
    assert set(got) == set(range(0, 300, 50))


def test_fusion(spark):
    df = spark.createDataFrame([(1, "1", 1), (1, "2", 2), (1, "2", 1), (1, "3", 2)], "q int, i string, rank int")
    got = {x.i: x.score for x in vectors.reciprocal_rank_fusion(df, "q", "i", "rank", k=10).collect()}
    assert got == pytest.approx({"2": 1 / 12 + 1 / 11, "1": 1 / 11, "3": 1 / 12})


# -- evaluation ---------------------------------------------------------------

def bounds(spark, ranking, grades, items, k):
    r = spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ranking)], "q int, i string, rank int")
    j = spark.createDataFrame([(1, i, g) for i, g in grades.items()], "q int, i string, grade int")
    u = spark.createDataFrame([(1, items)], "q int, items bigint")
    return evaluation.ranking_bounds(r, j, u, "q", "i", k=k, maximum=2).first()


def test_judged_ranking(spark):
    b = bounds(spark, ["C", "B", "A"], {"A": 2, "B": 1, "C": 0}, 3, 2)
    want = (1 / math.log2(3)) / (3 + 1 / math.log2(3))
    assert b.mrr_lo == b.mrr_hi == 0.5 and b.ndcg_lo == pytest.approx(want) and b.ndcg_hi == pytest.approx(want)


def test_bounds_hold_every_completion(spark):
    b = bounds(spark, ["C", "B", "A"], {"A": 2, "B": 0}, 3, 1)
    assert (b.precision_lo, b.precision_hi, b.recall_lo, b.recall_hi) == (0, 1, 0, 0.5) and b.mrr_lo == pytest.approx(1 / 3) and b.mrr_hi == 1
    for g in (0, 1, 2):
        x = bounds(spark, ["C", "B", "A"], {"A": 2, "B": 0, "C": g}, 3, 1)
        for m in ("precision", "recall", "ndcg", "mrr"):
            assert b[f"{m}_lo"] - 1e-9 <= x[f"{m}_lo"] <= x[f"{m}_hi"] <= b[f"{m}_hi"] + 1e-9


def test_classes_correlation_overlap(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "b"), (None, None)], "e string, p string")
    got = {x.label: (x.support, x.precision, x.recall) for x in evaluation.class_report(df, "e", "p").collect()}
    assert got == {"a": (2, 1.0, 0.5), "b": (1, pytest.approx(1 / 3), 1.0), None: (2, 1.0, 0.5)}
    s = spark.createDataFrame([("g", 1.0, 10.0), ("g", 2.0, 20.0), ("g", 2.0, 20.0), ("g", 9.0, 21.0), ("g", None, 1.0)], "g string, a double, b double")
    assert evaluation.spearman(s, ["g"], "a", "b").first().rho == pytest.approx(1.0)
    a = spark.createDataFrame([(["x", "y"], ["y", "z"]), ([], [])], "a array<string>, b array<string>").select(evaluation.jaccard(F.col("a"), F.col("b"))).collect()
    assert [x[0] for x in a] == [pytest.approx(1 / 3), None]
    m = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("h", 4.0)], "g string, v double")
    assert evaluation.macro_mean(m, "g", "v").first().macro == 3.0
    assert evaluation.macro_mean(m.union(spark.createDataFrame([("h", None)], "g string, v double")), "g", "v").first().macro is None


def test_bounds_where_nothing_can_be_relevant(spark):
    """No open item and no grade above 0: recall, NDCG and MRR are undefined; an empty ranking with grades is 0."""
    ranked = spark.createDataFrame([("none", "a", 1), ("none", "b", 2), ("zero", "a", 1)], "q string, d string, rank int")
    judged = spark.createDataFrame([("none", "a", 0), ("none", "b", 0), ("zero", "a", 0), ("zero", "b", 2), ("lost", "a", 2)], "q string, d string, grade int")
    universe = spark.createDataFrame([("none", 2), ("zero", 2), ("lost", 1), ("bare", 0)], "q string, items int")
    got = {r.q: r for r in evaluation.ranking_bounds(ranked, judged, universe, "q", "d", k=2, maximum=2).collect()}
    nothing = lambda r: [r.recall_lo, r.recall_hi, r.ndcg_lo, r.ndcg_hi, r.mrr_lo, r.mrr_hi]
    assert nothing(got["none"]) == [None] * 6 == nothing(got["bare"])
    assert nothing(got["zero"]) == [0.0] * 6 == nothing(got["lost"])


# -- coverage, anomaly, text --------------------------------------------------

def test_coverage(spark):
    e, p = spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1), ("c", 2)], "k string, v int")
    r = coverage.coverage_ratio(e, p, "k").first()
    assert (r.expected, r.covered, r.ratio) == (2, 1, 0.5) and [x.k for x in coverage.missing(e, p, "k").collect()] == ["b"]
    assert coverage.coverage_ratio(e.limit(0), p, "k").first().ratio is None
    d = coverage.reconcile(e, spark.createDataFrame([("a",), ("c",)], "k string")).collect()
    assert sorted((x.k, x.side) for x in d) == [("a", "left"), ("b", "left"), ("c", "right")]
    s = spark.createDataFrame([("x", "ok"), ("x", "failed"), ("y", "blocked"), ("z", None)], "g string, s string")
    assert {x.g: x.status for x in coverage.rollup_status(s, "g", "s", ["ok", "blocked", "failed"]).collect()} == {"x": "failed", "y": "blocked", "z": None}


def test_residuals_against_svd(spark):
    r = np.random.default_rng(4)
    m = r.normal(size=(60, 2)) @ r.normal(size=(2, 4)) + 0.01 * r.normal(size=(60, 4))
    m[5] += [0, 3, -2, 1]
    rows = [(i, "g", *map(float, v)) for i, v in enumerate(m)] + [(100 + i, "small", *map(float, r.normal(size=4))) for i in range(5)] + [(200, "g", None, 1.0, 1.0, 1.0), (201, None, 1.0, 1.0, 1.0, 1.0)] + [(300 + i, "flat", 1.0, 2.0, 3.0, float(i)) for i in range(15)]
    df = spark.createDataFrame(rows, "k bigint, c string, a double, b double, d double, e double")
    got = {x.k: x for x in anomaly.residuals(df, ["c"], "k", ["a", "b", "d", "e"]).collect()}
    q = np.quantile(m, [0.25, 0.5, 0.75], axis=0)
    x = (m - q[1]) / (q[2] - q[0])
    x = x - x.mean(0)
    u, s, v = np.linalg.svd(x, full_matrices=False)
    error = ((x - x @ v[:2].T @ v[:2]) ** 2).sum(1)
    assert np.allclose([got[i].error for i in range(60)], error, rtol=1e-6, atol=1e-9)
    assert got[5].flagged and sum(got[i].flagged for i in range(60)) == int((error > np.quantile(error, 0.95)).sum())
    assert {got[100].skipped, got[200].skipped, got[201].skipped, got[300].skipped} == {"small_cohort", "incomplete", "no_cohort", "few_active_features"} and len(got) == len(rows)


def test_residuals_of_data_of_low_rank(spark):
    """Exactly one or two components: nothing is left over, nobody stands out, however the data are shifted."""
    r = np.random.default_rng(5)
    for rank in (1, 2):
        for shift in (0.0, 50.0):
            m = r.normal(size=(40, rank)) @ r.normal(size=(rank, 4)) + shift
            df = spark.createDataFrame([(i, "g", *map(float, v)) for i, v in enumerate(m)], "k bigint, c string, a double, b double, d double, e double")
            got = anomaly.residuals(df, ["c"], "k", ["a", "b", "d", "e"]).collect()
            assert max(x.error for x in got) < 1e-9 and not any(x.flagged for x in got)


def test_text_helpers(spark):
    f = lambda fn, v: one(spark, v, "string", fn)
    assert f(text.fold, "  STRAßE　\n x ") == "strasse x" and f(text.bigrams, "机器人 a 水") == ["机器", "器人", "水"] and f(text.words, "a1 b-c") == ["a1", "b", "c"]
    assert [f(text.csv_safe, v) for v in ("=1", "+x", "-1", "@a", "ok", None)] == ["'=1", "'+x", "'-1", "'@a", "ok", ""]
    assert f(text.visible_html, "<p>a&amp;b</p><script>x<y</script><!-- c -->d") == "a&b d"
    assert [f(text.url_ok, v) for v in ("https://a.b/c?d", "ftp://a", "http://", "x", None, "http://u@h/")] == [True, False, False, False, False, True]
    assert f(lambda c: text.url_ok(c, allow_user=False), "http://u@h/") is False
    chunks = f(text.fixed_chunks, "x" * 900)
    assert [(c.char_start, len(c.chunk)) for c in chunks] == [(0, 480), (400, 480), (800, 100)]
    assert f(text.fixed_chunks, "") is None and f(text.fixed_chunks, None) is None and len(f(text.fixed_chunks, "x" * 480)) == 1
    x = spark.createDataFrame([("a" * 300 + "hit" + "b" * 2000, 300)], "t string, p int").select(text.excerpt(F.col("t"), F.col("p"))).first()[0]
    assert x.startswith("…") and x.endswith("…") and "hit" in x and len(x) == 1002
    cut = lambda t, p: spark.createDataFrame([(t, p)], "t string, p int").select(text.excerpt(F.col("t"), F.col("p"))).first()[0]
    # a text within the size is whole wherever the hit lies; near the end the window moves back
    assert cut("a" * 999 + "h", 999) == "a" * 999 + "h" and cut("ab" * 600, 1150) == "…" + ("ab" * 600)[200:] and cut("a" * 1200, None) == "a" * 1000 + "…" and cut(None, 3) is None and cut("", None) == ""


def test_sentences():
    t = "First. Second 3.5 one!\n\n 第三。四；End"
    assert [t[a:b] for a, b in sentences.spans(t)] == ["First.", "Second 3.5 one!", "第三。", "四；", "End"]
    assert sentences.spans("") == [] and sentences.spans(" \n\n ") == []
    assert sentences.windows(0, 1000, []) == [(0, 480), (320, 800), (520, 1000)] and sentences.windows(0, 1000, [500]) == [(340, 820)] and sentences.windows(5, 100, [9]) == [(5, 100)]
    assert sentences.windows(0, 1000, [10, 990, 995]) == [(0, 480), (520, 1000)]
    run = "Really?! Yes... no。。。是！？"
    assert [run[a:b] for a, b in sentences.spans(run)] == ["Really?!", "Yes... no。。。", "是！？"]


def test_stream_equals_batch(spark, sf, tmp_path):
    from quernstone.streaming import upserts

    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartition(5).write.parquet(str(tmp_path / "in"))
    key, order, keep = ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], ["event_id", "value"]
    stream = upserts.stream_parquet(spark, str(tmp_path / "in"), e.schema, files_per_batch=2)
    upserts.upsert_latest(stream, str(tmp_path / "state"), key, order, keep, ["ts"])
    want = sorted(tuple(r) for r in versions.latest(e, key, order, keep).collect())
    assert sorted(tuple(r) for r in upserts.read_latest(spark, str(tmp_path / "state"), key, order, keep).collect()) == want
    upserts.compact(spark, str(tmp_path / "state"), str(tmp_path / "small"), key, order, keep, ["ts"])
    assert sorted(tuple(r) for r in upserts.read_latest(spark, str(tmp_path / "small"), key, order, keep).collect()) == want


def test_topic_keywords_are_whole_words(spark):
    rows = [(1, "Headcounts rose; the headcount is 9."), (2, "impairments only"), (3, "\U0001f600 xheadcount Headcount"), (4, "研发headcount团队"), (5, "headcount"), (6, "überkapazitäten"), (7, None), (8, "headcount2 a.b headcount.")]
    df = spark.createDataFrame(rows, "d bigint, t string")
    topics = {"people": ["headcount"], "risk": ["impairment"], "capacity": ["kapazität"], "dots": ["a.b", "axb"]}
    got = sorted(tuple(r) for r in lexical.topic_hits(df, "d", "t", topics).select("d", "topic", "keyword", "position").collect())
    assert got == [(1, "people", "headcount", 21), (3, "people", "headcount", 13), (4, "people", "headcount", 2), (5, "people", "headcount", 0), (6, "capacity", "kapazität", 4), (8, "dots", "a.b", 11), (8, "people", "headcount", 15)]


# -- passages, models, gates --------------------------------------------------

def test_passages_score_once_and_keep_versions(spark):
    from quernstone.operators import passages

    docs = spark.createDataFrame([(1, "A", "Robot arms ship. Other words here.", 1), (2, "A", "ROBOT  arms ship.", 5), (3, "B", "Robot arms ship.", 2), (4, None, "Robot.", 1), (5, "A", None, 1)], "d bigint, g string, t string, day int")
    p = passages.passages(docs, "d", "t", "g", "day")
    rows = p.collect()
    assert len(rows) == 4 and {r.excerpt for r in rows if r.d == 1} == {"Robot arms ship.", "Other words here."}
    asked = spark.createDataFrame([(1, "robot")], "q bigint, s string")
    got = {(r.g, r.place): (r.versions, r.newest, round(r.score, 9)) for r in passages.search(p, "g", "d", "day", asked, "q", "s").collect()}
    assert got[("A", 1)][:2] == (2, 5) and got[("B", 1)][:2] == (1, 2) and got[("A", 1)][2] == got[("B", 1)][2] and len(got) == 2


def test_passages_read_compatibility_forms(spark):
    """Full-width letters, ligatures and radicals are words like any others, in texts and in queries."""
    from quernstone.operators import passages

    docs = spark.createDataFrame([(1, "A", "Efficient ROBOT2 arms."), (2, "A", "E\ufb03cient ＲＯＢＯＴ２ arms."), (3, "B", "\u2f08工智能。"), (4, "B", "人工智能。"), (5, "C", "cafe\u0301 STRASSE."), (6, "C", "caf\u00e9 straße.")], "d bigint, g string, t string").withColumn("day", F.lit(1))
    p = passages.passages(docs, "d", "t", "g", "day")
    assert p.select("unit").distinct().count() == 3 and p.count() == 6
    asked = spark.createDataFrame([(1, "ｒｏｂｏｔ２"), (2, "\u2f08工")], "q bigint, s string")
    got = {(r.q, r.g): r.versions for r in passages.search(p, "g", "d", "day", asked, "q", "s").collect()}
    assert got == {(1, "A"): 2, (2, "B"): 2}


def test_passages_cut_long_sentences(spark):
    from quernstone.operators import passages

    long = "x" + " robot" * 200
    docs = spark.createDataFrame([(1, "A", f"Short one. {long}. End.", 1)], "d bigint, g string, t string, day int")
    rows = sorted(passages.passages(docs, "d", "t", "g", "day").collect(), key=lambda r: r.char_start)
    text = f"Short one. {long}. End."
    assert [(r.char_start, r.char_end) for r in rows] == [(0, 10), (11, 491), (331, 811), (733, 1213), (1214, 1218)]
    assert all(r.excerpt == text[r.char_start : r.char_end] for r in rows)


def test_models(spark):
    from quernstone.operators import models

    df = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, ""), (4, None)], "k bigint, t string")
    e = models.encode_distinct(df, "t", models.HashEncoder(16)).collect()
    assert len(e) == 2 and all(len(r.embedding) == 16 for r in e)
    assert np.allclose(models.HashEncoder(16).encode(["abc"])[0], next(r.embedding for r in e if sum(x > 0 for x in r.embedding)))
    c = spark.createDataFrame([(1, "robot", 1, "a robot"), (1, "robot", 2, None), (2, "arm", 1, "arms")], "q bigint, qt string, d bigint, t string")
    got = {(r.q, r.d): r.rerank_score for r in models.rerank(c, "q", "qt", "d", "t", models.OverlapReranker()).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 1.0}


def test_gates_and_beam(spark):
    from quernstone.operators import gates

    t = lambda v: spark.createDataFrame([(v,)], "v double")
    got = {r.check: r.passed for r in gates.gates({"a": (t(0.5), "v", ">=", 0.5), "b": (t(2.0), "v", "<=", 1), "c": (t(None), "v", ">=", 0)}).collect()}
    assert got == {"a": True, "b": False, "c": False}
    r = random.Random(6)
    axes = {"x": range(4), "y": range(4), "z": range(3)}
    for _ in range(20):
        table = {(a, b, c): r.random() for a in range(4) for b in range(4) for c in range(3)}
        best = gates.beam(axes, lambda c: (table[(c["x"], c["y"], c["z"])],), width=100)[0]
        assert best[0][0] == min(table.values())
        assert gates.beam(axes, lambda c: (table[(c["x"], c["y"], c["z"])],), width=1)[0][0] >= best[0]


# -- hot keys -----------------------------------------------------------------

def test_near_duplicates_with_one_hot_group(spark):
    """Nine tenths of the texts belong to one issuer, and all of them share most words; against all pairs."""
    r = random.Random(3)
    common = [f"w{i}" for i in range(12)]
    rows, originals = [], []
    for i in range(150):
        if originals and r.random() < 0.3:
            words = r.choice(originals).split()
            words[r.randrange(len(words))] = f"z{r.randint(0, 5)}"
            t = " ".join(words)
        else:
            t = " ".join(common + [f"u{r.randint(0, 400)}" for _ in range(30)])
            originals.append(t)
        rows.append((i, "HOT" if i % 10 else "B", t, i))
    df = spark.createDataFrame(rows, "d bigint, g string, t string, o int")
    got = {x.d: x.match for x in lexical.near_duplicates(df, "d", "t", "g", ["o"], threshold=0.8).collect()}
    counts = [{w: t.split().count(w) for w in t.split()} for _, _, t, _ in rows]
    df_of = {}
    for c in counts:
        for w in c:
            df_of[w] = df_of.get(w, 0) + 1
    vec = []
    for c in counts:
        v = {w: (1 + np.log(n)) * (np.log((1 + len(rows)) / (1 + df_of[w])) + 1) for w, n in c.items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        vec.append({w: x / size for w, x in v.items()})
    want = {}
    for i, (_, g, t, _) in enumerate(rows):
        same = [j for j in range(i) if rows[j][1] == g and rows[j][2] == t]
        if same:
            want[i] = same[0]
            continue
        best = [(-round(sum(x * vec[j].get(w, 0) for w, x in vec[i].items()), 9), j) for j in range(i) if rows[j][1] == g and rows[j][2] not in [rows[k][2] for k in range(j) if rows[k][1] == g]]
        best = [b for b in best if -b[0] >= 0.8]
        if best:
            want[i] = min(best)[1]
    assert got == want and len(want) > 20


def test_cosine_with_queries_too_large_to_broadcast(spark, monkeypatch):
    r = np.random.default_rng(2)
    v = r.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(300)], "k bigint, e array<double>")
    q = df.where("k % 3 = 0").select(df.k.alias("q"), df.e.alias("qe"))
    rows = lambda: sorted((x.q, x.k, x.rank) for x in vectors.cosine_topk(df, "k", "e", q, "q", "qe", k=4).collect())
    first = rows()
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 64)
    assert rows() == first and len(first) == 400


def test_bm25_with_queries_too_large_to_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "the robot arm " + ("gear " * (i % 4)) + f"n{i}") for i in range(60)] + [(99, None)], "d bigint, t string")
    asked = spark.createDataFrame([(1, "robot gear"), (2, "the n7"), (3, "nothing else")], "q bigint, s string")
    rows = lambda: sorted((x.q, x.d, round(x.score, 9)) for x in lexical.bm25(docs, "d", "t", asked, "q", "s").collect())
    first = rows()
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", 0)
    assert rows() == first and len(first) == 120


def test_latent_encoder_and_reranker_learn():
    """Two subjects in texts that share no words: texts of one are nearer, also to a query in other words of it; judged pairs are told apart."""
    from quernstone.operators import models

    r = random.Random(1)
    subjects = [["turbine", "blade", "rotor", "wind", "nacelle", "gearbox"], ["insulin", "dosage", "patient", "clinic", "trial", "serum"]]
    texts = [" ".join(r.choice(subjects[i % 2]) for _ in range(12)) for i in range(300)]
    e = models.LatentEncoder.fit(texts, width=512, dim=2)
    v = e.encode(["turbine blade", "rotor nacelle gearbox", "insulin dosage serum", ""])
    assert v[0] @ v[1] > v[0] @ v[2] + 0.3 and np.allclose(np.linalg.norm(v[:3], axis=1), 1, atol=1e-5) and not v[3].any()
    queries = ["wind turbine", "insulin trial"]
    judged = [(queries[q], t, i % 2 == q) for i, t in enumerate(texts[:200]) for q in (0, 1)]
    m = models.TrainedReranker.fit(e, judged)
    held = [(m.rerank(queries[q], [t])[0] > 0.5) == (i % 2 == q) for i, t in enumerate(texts[200:]) for q in (0, 1)]
    assert sum(held) / len(held) > 0.95
    assert models.TrainedReranker.fit(e, []).rerank("x", ["y"]) == [0.5] and models.LatentEncoder.fit(["a"]).encode(["a"]).shape == (1, 64)
