"""Near-duplicate documents and vectors, and the components that join their links."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from docsieve.llm.components import components
from docsieve.llm.near_dup import least_overlap, near_duplicates, shingle_hashes
from docsieve.llm.vectors import close_pairs, home_ball, linked_vectors, nested_balls, unit_rows


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_components(spark):
    draw = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(draw.randint(0, 90), draw.randint(0, 90)) for _ in range(60)] + [(500, n) for n in range(501, 700)] + [(7, 7), (3, 3)]
    rows = [(a, b) for a, b in links] + [(None, 5), (6, None), links[0], (links[1][1], links[1][0])]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    proper = [(a, b) for a, b in links if a != b]
    assert got == smallest_reachable({n for e in proper for n in e}, proper)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_groups(rows, words, percent):
    sets = {}
    for i, text in rows:
        found = (text or "").encode()
        found = bytes(b + 32 if 65 <= b <= 90 else b for b in found).split()
        sets[i] = {tuple(found[k : k + words]) for k in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, smallest_reachable(sets, links)


def edited(base, draw, changes):
    words = list(base)
    for _ in range(changes):
        words[draw.randrange(len(words))] = draw.choice(["new%d" % draw.randint(0, 9), "word%d" % draw.randint(0, 300)])
    return words


@pytest.mark.parametrize("k,k_long", [(32, 512), (32, 64)])
def test_near_duplicates_against_brute_force(spark, k, k_long):
    draw = random.Random(4)
    vocabulary = ["word%d" % i for i in range(300)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "a b c d"), (8, "A  b\nc D"), (9, "é É x y"), (10, "é é x y")]
    passage = [draw.choice(vocabulary) for _ in range(40)]
    for group, size in enumerate((10, 25, 60, 130, 700)):
        base = [draw.choice(vocabulary) for _ in range(size)]
        for copy in range(25):
            rows.append((1000 * (group + 1) + copy, " ".join(edited(base, draw, draw.randint(0, max(1, size // 12))))))
    for i in range(40):  # many texts with one long passage
        rows.append((9000 + i, " ".join([*passage, *[draw.choice(vocabulary) for _ in range(draw.choice((4, 12, 60)))]])))
    draw.shuffle(rows)
    sizes, groups = brute_groups(rows, 4, 80)
    docs = spark.createDataFrame([(i, t, i, True) for i, t in rows], "doc_id long, text string, n long, kept boolean")
    got = near_duplicates(docs, words=4, percent=80, k=k, k_long=k_long).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert {r["doc_id"]: r["component_id"] for r in got} == groups
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_near_duplicates_of_contained_copies_around_the_exact_range(spark):
    fresh = iter("w%d" % i for i in range(10**6))

    def some(n):
        return [next(fresh) for _ in range(n)]

    rows = []
    for n in (*range(405, 431), 511, 512, 513, 640):  # n shingles of four words, and the fewest of them that are similar enough
        whole, least = some(n + 3), -(-n * 80 // 100)
        rows += [(10 * n, " ".join(whole)), (10 * n + 1, " ".join(whole[: least + 3])), (10 * n + 2, " ".join(whole[: least + 2]))]
        if n % 2:  # the rarest values of the whole are in its end, which another text has too; two texts have the rest
            rows += [(10 * n + 3, " ".join([*whole[least:], *some(60)])), (10 * n + 4, " ".join([*whole[: n // 2], *some(80)])), (10 * n + 5, " ".join([*whole[n // 2 - 9 : least + 3], *some(80)]))]
    # the copy that is one shingle short of the least overlap is linked with the other copy, not with the whole
    sizes, groups = brute_groups([r for r in rows if r[0] % 10 != 2], 4, 80)
    assert sum(i != g for i, g in groups.items()) == 30
    got = near_duplicates(spark.createDataFrame([r for r in rows if r[0] % 10 != 2], "doc_id long, text string"), words=4, percent=80).collect()
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert {r["doc_id"]: r["component_id"] for r in got} == groups
    short = [r for r in rows if r[0] % 10 in (0, 2)]
    assert all(r["kept"] for r in near_duplicates(spark.createDataFrame(short, "doc_id long, text string"), words=4, percent=80).collect())


def test_near_duplicates_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e f")] * 50 + [(3, "a b c d e f"), (None, "a b c d e f"), (None, None), (8, "x")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(5, 3, False), (3, 3, True), (None, 3, True), (None, None, True), (8, 8, True)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shingles_and_overlap():
    assert len(shingle_hashes("a b a b a b", 2)) == 2 and len(shingle_hashes("a b", 3)) == 1
    assert (shingle_hashes("A b C", 2) == shingle_hashes("a\tB  c", 2)).all() and len(shingle_hashes(None, 2)) == 0
    for k in (32, 64, 512):
        least = least_overlap(k, 80)
        below = sum(math.comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(least))
        assert below <= 1e-12 < below + math.comb(k, least) * 0.8**least * 0.2 ** (k - least)


def cluster_rows(seed, n, d):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, d))
    x = centres[draw.integers(0, 6, n)] + draw.normal(size=(n, d)) * draw.choice([0.01, 0.1, 1.0], size=(n, 1))
    return np.float32(x).astype(float)


@pytest.mark.parametrize("n,d", [(0, 3), (1, 3), (400, 8), (500, 3)])
def test_dual_traversal_equals_all_pairs(n, d):
    x = unit_rows(cluster_rows(1, n, d)) if n else np.empty((0, d))
    y = unit_rows(cluster_rows(2, 150, d))
    i, j = close_pairs(x, x, 0.98, True)
    assert sorted((min(p), max(p)) for p in zip(i, j)) == sorted((a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.98)) if a < b)
    i, j = close_pairs(x, y, 0.98, False)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(x @ y.T >= 0.98)))


def test_home_balls_cover():
    x = unit_rows(cluster_rows(3, 600, 5))
    balls = nested_balls(x[:80], 0.05)
    node, distance = home_ball(balls, x)
    assert np.allclose(np.linalg.norm(x - balls[0][node], axis=1), distance, atol=1e-7) and (distance <= np.array(balls[1])[node] + 1e-7).all()


@pytest.mark.parametrize("sample,block", [(2048, 1024), (40, 30), (1, 20), (0, 16)])
def test_vectors_against_brute_force(spark, sample, block):
    x = cluster_rows(5, 300, 4)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist(), 0) for i in range(90)]  # one vector many times
    rows += [(2000, (3 * x[0]).tolist(), 0), (2001, x[0].tolist(), None), (2002, None, 0), (2003, [0.0] * 4, 0), (2004, [1.0, None, 0.0, 0.0], 0), (2005, [float("nan"), 1.0, 0.0, 0.0], 0),
             (2006, [float("inf"), 1.0, 0.0, 0.0], 0), (2007, [1.0, 2.0], 0), (2008, [1.0, 2.0], 0), (2009, [], 0), (2010, [1e300, 1e300, 0.0, 0.0], 1), (2011, [1e-300, 1e-300, 0.0, 0.0], 1), (3, x[3].tolist(), 0)]
    frame = spark.createDataFrame([(*r, "g") for r in rows], "vec_id long, embedding array<double>, label int, g string")
    got = linked_vectors(frame, 0.98, sample=sample, block=block).collect()
    sound = [(i, np.array(v, float), l) for i, v, l in rows if l is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    links = set()
    for a, va, la in sound:
        for b, vb, lb in sound:
            if a != b and la == lb and len(va) == len(vb):
                va1, vb1 = unit_rows(va[None])[0], unit_rows(vb[None])[0]
                if va1 @ vb1 >= 0.98:
                    links.add((a, b))
    reach = smallest_reachable({r[0] for r in rows}, links)
    count = {r[0]: sum(a == r[0] for a, _ in links) for r in rows}
    assert len(got) == len(rows)
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(i, count[i], reach[i], reach[i] == i) for i in reach}


def test_vectors_without_rows(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert linked_vectors(frame).count() == 0


def test_only_paired_sets_move(spark):
    from docsieve.llm.near_dup import _confirmed

    sets = spark.createDataFrame([(i, list(range(i % 4, 20 + i % 4))) for i in range(40)], "rep long, hashes array<long>")
    pairs = spark.createDataFrame([(0, 4), (1, 7), (0, 400)], "a long, b long")
    out = _confirmed(pairs, sets, 16, 80)
    assert "Join LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [(0, 4), (1, 7)]
    assert _confirmed(pairs.where("false"), sets, 16, 80).count() == 0
