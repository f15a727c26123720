import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quernstone.llm import encode, packing


def fewest(sizes, capacity):
    """Brute force over set partitions."""
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best if sizes else 0


def test_optimal_on_small_sets():
    r = random.Random(3)
    for _ in range(150):
        sizes = [r.randint(1, 20) for _ in range(r.randint(0, 8))]
        bins = packing.pack(sizes, 20)
        assert Counter(itertools.chain(*bins)) == Counter(sizes) and all(sum(b) <= 20 for b in bins)
        assert len(bins) == fewest(sizes, 20)
        assert packing.lower_bound(np.array(sizes), 20) <= len(bins)


@pytest.mark.parametrize(("lo", "hi"), [(1, 2048), (600, 1400), (300, 1023), (1, 60)])
def test_large_sets_stay_near_the_bound(lo, hi):
    r = random.Random(lo)
    sizes = [r.randint(lo, hi) for _ in range(1500)]
    bins = packing.pack(sizes, nodes=4000)
    assert Counter(itertools.chain(*bins)) == Counter(sizes) and max(map(sum, bins)) <= 2048
    assert packing.lower_bound(np.array(sizes), 2048) <= len(bins) <= len(packing.best_fit(sizes, 2048))


def test_branching_beats_best_fit():
    r = random.Random(3)
    better = 0
    for _ in range(20):
        sizes = [r.randint(300, 1023) for _ in range(60)]
        better += len(packing.pack(sizes)) < len(packing.best_fit(sizes, 2048))
    assert better > 0


@pytest.mark.parametrize("seed", [144, 192, 267, 359, 444])
def test_finds_what_likely_fillings_miss(seed):
    r = random.Random(seed)
    sizes = [r.randint(15, 60) for _ in range(r.randint(9, 16))]
    bins = packing.pack(sizes, 100)
    assert Counter(itertools.chain(*bins)) == Counter(sizes) and max(map(sum, bins)) <= 100
    assert len(bins) == fewest(sizes, 100)


def fits_inside(b, a):
    """Can the items of b be put inside those of a? Every way, by brute force."""
    return not b or any(b[0] <= x and fits_inside(b[1:], (*a[:i], x - b[0], *a[i + 1 :])) for i, x in enumerate(a))


def test_fillings_leave_out_only_dominated_ones():
    r = random.Random(5)
    for _ in range(200):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 9))), reverse=True)
        room = r.randint(1, 40)
        got = [f for f in packing.fillings(packing._Left(sizes), room, room) if f is not None]
        every = {c for k in range(1, len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room}
        assert set(got) - {()} <= every and len(got) == len(set(got))
        assert all(any(fits_inside(f, g) for g in got) for f in every)


def test_many_small_items_in_a_room():
    left = packing._Left([1] * 3000 + [2] * 5)
    assert all(sum(f) <= 2000 for f in itertools.islice(packing.fillings(left, 2000, 2000), 20) if f)


def test_dominance():
    assert packing.dominates((10,), (5, 5)) and packing.dominates((6, 5), (6, 4)) and packing.dominates((8, 3), (4, 4, 3))
    assert not packing.dominates((5, 5), (10,)) and not packing.dominates((6, 3), (5, 4))


def test_dominance_against_brute_force():
    r = random.Random(8)
    for _ in range(3000):
        a, b = (tuple(sorted((r.randint(1, 9) for _ in range(r.randint(1, 4))), reverse=True)) for _ in range(2))
        assert packing.dominates(a, b) == fits_inside(b, a), (a, b)
    assert packing.dominates((5, 3), (5,)) and packing.dominates((6, 1), (3, 3))


def test_exact_sums():
    r = random.Random(4)
    for even in (False, True):
        for _ in range(300):
            sizes = sorted((r.randint(1, 12) for _ in range(r.randint(1, 9))), reverse=True)
            target, k = r.randint(1, 30), r.randint(1, 5)
            got = [f for f in packing.exact(packing._Left(sizes), target, k, even) if f is not None]
            assert len(got) == len(set(got)) and set(got) == {c for c in itertools.combinations(sizes, k) if sum(c) == target}


@pytest.mark.parametrize(("lo", "hi", "gap"), [(1, 2048, 3), (300, 1023, 12), (600, 1400, 16), (200, 800, 4)])
def test_stated_gaps(lo, hi, gap):
    r = random.Random(1)
    sizes = [r.randint(lo, hi) for _ in range(4096)]
    assert len(packing.pack(sizes)) - packing.lower_bound(np.array(sizes), 2048) <= gap


def test_gaps_and_partitions(spark):
    df = spark.range(900).selectExpr("id as doc_id", "repeat('word ', cast(id % 300 as int)) as text")
    packed = packing.pack_texts(df, "doc_id", "text", block_items=100)
    rows = packing.gaps(packed).collect()
    assert len(rows) == 9 and all(0 <= g.gap == g.containers - g.bound <= 1 for g in rows)
    assert sum(g.containers for g in rows) == packed.where("n_tokens > 0").select("container_id").distinct().count()
    assert packing.gaps(packed.limit(0)).count() == 0
    # no task packs all blocks
    assert packed.rdd.getNumPartitions() >= 9


def test_frames(spark):
    r = random.Random(9)
    rows = [(i, " ".join(["word"] * r.choice([0, 1, 5, 300, 900, 1500, 2048, 2049, 7000]))) for i in range(80)] + [(900, None), (901, ""), (5, "again"), (5, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n_tokens int").repartition(3)
    got = packing.pack_texts(df, "doc_id", "text", block_items=40).collect()
    enc = encode.encoder(encode.vocabulary_path())
    need = sorted((i, len(enc.encode_ordinary(t or ""))) for i, t in rows)
    pieces = defaultdict(list)
    filled = Counter()
    for g in got:
        assert g.n_tokens == g.token_end - g.token_start <= 2048
        filled[g.container_id] += g.n_tokens
        pieces[g.doc_id].append(g)
    assert max(filled.values()) <= 2048
    once = {i: n for i, n in need if i != 5}
    for i, n in once.items():
        ps = sorted(pieces[i], key=lambda g: g.piece_no)
        assert [p.piece_no for p in ps] == list(range(len(ps))) and ps[0].token_start == 0 and ps[-1].token_end == n
        assert all(a.token_end == b.token_start and a.n_tokens == 2048 for a, b in zip(ps, ps[1:]))
        assert len(ps) == max(1, -(-n // 2048))
    assert len(pieces[5]) == sum(max(1, -(-n // 2048)) for i, n in need if i == 5)
    total = sum(n for _, n in need)
    assert len([c for c, n in filled.items() if n]) <= -(-total // 2048) + 3
    assert packing.pack_texts(df.limit(0), "doc_id", "text").count() == 0


def test_only_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in packing.pack_texts(df, "doc_id", "text").collect()) == [(1, 0), (2, 0)]
