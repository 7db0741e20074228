"""Clustering against plain integer loops."""

import hashlib

import numpy as np

from tidemark.llm import centroids, vectors


def plain(rows, k, rounds, size):
    kept = [(i, [int(np.floor(float(x) * 256)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [x for _, x in first]
    nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs))[::-1]
    for _ in range(rounds):
        own = [nearest(x)[0] for _, x in kept]
        for j in set(own):
            mine = [x for (_, x), o in zip(kept, own) if o == j]
            cs[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, *nearest(x)) for i, x in kept], cs


def norm(rows):
    return sorted(((i is None, i or 0, c, d) for i, c, d in rows))


def check(spark, rows, k=4, rounds=3, size=5):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, x int").repartition(3)
    got, cs = centroids.cluster(df, k=k, rounds=rounds, size=size)
    want, want_cs = plain(rows, k, rounds, size)
    assert norm((r.vec_id, r.cluster, r.distance) for r in got.collect()) == norm(want)
    cs = sorted(cs.collect())
    assert [r.centroid for r in cs] == want_cs
    assert [r.cluster_inertia for r in cs] == [sum(d for _, c, d in want if c == j) for j in range(len(cs))]


def test_random_vectors(spark):
    rng = np.random.default_rng(3)
    check(spark, [(k, [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(300, 5)))], k=7, rounds=5)


def test_edges(spark):
    rng = np.random.default_rng(4)
    vec = lambda: [float(x) for x in rng.normal(size=5)]
    rows = [(k, vec()) for k in range(40)]
    rows += [(100, None), (101, []), (102, [1.0] * 4), (103, [1.0] * 6), (104, [1.0, None, 1, 1, 1]), (105, [float("nan")] * 5), (106, [float("inf"), 0, 0, 0, 0]), (107, [0.0, -float("inf"), 0, 0, 0])]
    rows += [(None, vec()), (7, vec()), rows[3], rows[3]] + [(200 + k, [0.5, -0.5, 0.25, 0.0, 3.0]) for k in range(60)]
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    check(spark, rows, k=6)
    check(spark, [(k, [1.0] * 5) for k in range(9)], k=3)  # equal centroids: the smallest number takes all
    check(spark, rows[:2], k=5)
    df = spark.createDataFrame([(1, [1e30] * 5), (2, None)], "vec_id long, embedding array<double>")
    got, cs = centroids.cluster(df, size=5)
    assert got.count() == 0 and cs.count() == 0 and got.columns == ["vec_id", "cluster", "distance"]


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.integers(-(1 << 19), 1 << 19, 5) * 2]) for k in range(60)]
    check(spark, rows)
    a = rng.integers(-(1 << 28), 1 << 28, (4, 6))
    assert (vectors.exact_dot(a, a) == a @ a.T).all()


def test_only_changed_components_are_used():
    rng = np.random.default_rng(6)
    x, old = rng.integers(-50, 50, (20, 8)), rng.integers(-50, 50, (3, 8))
    new = old.copy()
    new[1, [2, 5]] += [3, -7]
    got = centroids.updated(x, x @ old.T, old, new)
    assert (got == x @ new.T).all()
    spoilt = x.copy()
    spoilt[:, [0, 1, 3, 4, 6, 7]] = 999  # not read
    assert (centroids.updated(spoilt, x @ old.T, old, new) == got).all()
