import datetime
import random

from quernstone.operators import asof

D = datetime.date(2024, 1, 1)
EVENTS = "event_id bigint, run_id string, ticker string, day date, entity_key string"
VERSIONS = "version_id bigint, run_id string, ticker string, own date, pub date, revision bigint, bucket int"
ARGS = dict(event_id="event_id", event_key=["run_id", "ticker"], event_day="day", version_id="version_id", version_key=["run_id", "ticker"], own_day="own", pub_day="pub", revision="revision")


def day(n):
    return None if n is None else D + datetime.timedelta(n)


def brute(events, versions):
    out = []
    for e in events:
        if None in (e[1], e[2], e[3]):
            continue
        known = [v for v in versions if v[1] == e[1] and v[2] == e[2] and v[3] is not None and v[4] is not None and v[3] <= e[3] and v[4] <= e[3]]
        if known:
            out.append((e[0], max(known, key=lambda v: (v[3], v[4], -1 if v[5] is None else v[5], -v[0]))[0]))
    return sorted(out)


def run(spark, events, versions, **kw):
    e, v = spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS)
    return sorted(tuple(r) for r in asof.attach_known(e, v, **ARGS, **kw).collect())


def test_random_against_brute_force(spark):
    r = random.Random(5)
    pick = lambda xs: r.choice(xs)
    events = [(i, pick(["r1", "r2", None]), pick(["A", "B", "1:A", None]), day(pick([None, *range(30)])), "k") for i in range(200)]
    versions = [(i, pick(["r1", "r2", "r", None]), pick(["A", "B", "1:A"]), day(pick([None, *range(30)])), day(pick([None, *range(30)])), pick([None, 0, 1, 2]), 1) for i in range(400)]
    assert run(spark, events, versions) == brute(events, versions)
    assert run(spark, events, versions, buckets=1) == brute(events, versions)


def test_hot_key_ties_and_repeats(spark):
    versions = [(i, "r", "HOT", day(i % 7), day(i % 5), i % 3, 0) for i in range(3000)]
    events = [(i % 50, "r", "HOT", day(i % 9), "x") for i in range(500)]
    assert run(spark, events, versions) == brute(events, versions)


def test_nothing_known(spark):
    assert run(spark, [(1, "r", "A", day(0), "x")], [(1, "r", "A", day(1), day(0), 0, 0)]) == []
    assert run(spark, [], [(1, "r", "A", day(1), day(0), 0, 0)]) == []
    assert run(spark, [(1, "r", "A", day(0), "x")], []) == []
