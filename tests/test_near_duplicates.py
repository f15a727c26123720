"""Near-duplicates against all pairs, by hand; terms as arrays against Spark's expressions."""

import math
import os
import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from quernstone.functions import text as tx
from quernstone.operators import bags, lexical


def test_terms_as_arrays(spark, monkeypatch):
    """The same terms as text.terms(): long words, runs of CJK, letters that become plain in lower case, empty texts, slices."""
    long = "abcdefghijkl" * 5
    texts = [None, "", " \n", "a", "Straße STRASSE ẞ", "\u212a\u0130 Éa9", f"{long} {long}m {long} abcdefghijkl abcdefghijklm", "机器人手臂 机 a机b", "㐀䶿䷀一鿿ꀀ", "😀机😀器人😀", "0 00 a0 0a a", "x\ny", "机", "器人"]
    texts += ["w" * i + " 机器" * (i % 3) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.replace(F.lower("t"), F.lit("ß"), F.lit("ss")).alias("low"), tx.terms(F.col("t")).alias("terms")).orderBy("i").collect()
    monkeypatch.setattr(bags, "SLICE", 30)
    row, term, tf = bags.counts(pa.array([r.low for r in rows], pa.string()))
    number: dict[str, int] = {}
    for r in rows:
        words = Counter(r.terms or [])
        assert sorted(tf[row == r.i].tolist()) == sorted(words.values()), r
        for w in words:
            alone = bags.counts(pa.array([w]))
            assert len(alone[1]) == 1 and number.setdefault(w, int(alone[1][0])) in term[row == r.i]
    assert len(set(number.values())) == len(number) and (row[1:] >= row[:-1]).all()


def _nearest_by_hand(rows, threshold):
    """{d: (match, similarity)} of (d, group, text, order), all pairs of a group compared."""
    bags = {d: {w: t.split().count(w) for w in t.split()} for d, _, t, _ in rows}
    freq = {}
    for b in bags.values():
        for w in b:
            freq[w] = freq.get(w, 0) + 1
    vec = {}
    for d, b in bags.items():
        v = {w: (1 + math.log(c)) * (math.log((1 + len(rows)) / (1 + freq[w])) + 1) for w, c in b.items()}
        vec[d] = {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()}
    want = {}
    for d, g, _, o in rows:
        near = [(-round(min(1.0, sum(x * vec[e].get(w, 0) for w, x in vec[d].items())), 9), p, e) for e, h, _, p in rows if h == g and (p, e) < (o, d)]
        near = [x for x in near if -x[0] >= threshold]
        if near:
            want[d] = (min(near)[2], round(-min(near)[0], 6))
    return want


def test_near_duplicates_of_a_group_in_chunks(spark, monkeypatch):
    """A group above the bytes of a block is divided; any two of its texts must meet, and each counts once for its terms."""
    r = random.Random(5)
    rows = []
    for i in range(120):
        if rows and r.random() < 0.4:
            words = r.choice(rows)[2].split()
            words[r.randrange(len(words))] = f"z{r.randint(0, 5)}"
        else:
            words = [f"w{r.randint(0, 90)}" for _ in range(r.randint(5, 40))]
        rows.append((i, "HOT" if i % 8 else "B", " ".join(words), r.randint(0, 9)))
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 2000)
    df = spark.createDataFrame(rows, "d bigint, g string, t string, o int")
    got = {x.d: (x.match, round(x.similarity, 6)) for x in lexical.near_duplicates(df, "d", "t", "g", ["o"], threshold=0.85).collect()}
    want = _nearest_by_hand(rows, 0.85)
    assert got == want and len(want) > 20


def test_near_duplicates_take_the_earliest_of_equal_ones(spark):
    """A text with other marks is as near as a copy, and comes first."""
    rows = [(1, "A", "one two three", 0), (2, "A", "one, two, three!", 1), (3, "A", "one, two, three!", 2), (4, "A", "four five", 3)]
    df = spark.createDataFrame(rows, "d bigint, g string, t string, o int")
    got = {x.d: (x.match, x.similarity) for x in lexical.near_duplicates(df, "d", "t", "g", ["o"]).collect()}
    assert got == {2: (1, 1.0), 3: (1, 1.0)}


def test_near_duplicates_write_little(spark, sf):
    """Of the texts alone something of the size of the input is written, and never their terms."""
    source = f"{sf}/../sf0.1/documents.parquet"
    docs = spark.read.parquet(source).selectExpr("doc_id", "text", "upper(trim(ticker)) as ticker", "available_at")
    size = sum(len(t.encode()) for t, in docs.select("text").collect() if t)
    gateway = spark.sparkContext._gateway
    status, every = spark.sparkContext._jsc.sc().statusStore(), gateway.jvm.java.util.ArrayList()

    def written() -> int:
        stages = status.stageList(every, False, False, gateway.new_array(gateway.jvm.double, 0), every)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    tables = lambda: sum(os.path.getsize(os.path.join(f, n)) for f, _, names in os.walk(spark.conf.get("spark.checkpoint.dir")) for n in names)
    before = written() + tables()
    assert lexical.near_duplicates(docs, "doc_id", "text", "ticker", ["available_at"]).count() > 100
    # once all texts, dealt out above and then to the blocks, packed by Spark's own codec to less than half
    assert written() + tables() - before < 1.2 * size
