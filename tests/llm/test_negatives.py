"""Hard negatives against a plain search over all rows."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import negatives


def plain(rows, every=10, positives=3, best=4):
    kept = {(i, lab, tuple(int(np.floor(float(x) * 256)) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    kept = {r for r in kept if sum(c * c for c in r[2]) < 1 << 60}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = sorted({(-dot(a[2], r[2]), r[0], r[1] == a[1]) for r in kept if r[0] != a[0]})
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            inside = [(s, i) for s, i, same in scored if not same and -30 * p <= -100 * s <= -90 * p][:best]
            out += [(a[0], pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(inside)]
    return sorted(out)


def check(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, label int, embedding array<double>, score double").repartition(4)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), positives=3, negatives=4, **kw)
    want = plain(rows)
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_clusters_ties_and_edges(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(6, 8))
    rows = [(k, int(rng.integers(3)), [float(x) for x in middle[k % 6] + rng.normal(size=8) / 3]) for k in range(400)]
    rows += [(1000 + k, k % 3, rows[0][2]) for k in range(50)]  # one very common vector
    rows += [rows[20], rows[20], rows[7], (20, 2, rows[3][2]), (None, 1, rows[1][2]), (2000, None, rows[1][2]), (2010, 1, None), (2020, 1, []), (2030, 1, [1.0, 2.0]), (2040, 2, [None, 1.0]), (2050, 2, [float("nan")] * 8), (2060, 2, [float("inf")] * 8), (2070, 2, [1e300] * 8), (2080, 9, rows[5][2])]
    assert len(check(spark, rows)) > 300
    assert check(spark, rows[:1]) == []
    assert check(spark, [(10, 1, [-1.0, 0.0]), (3, 1, [1.0, 0.0]), (4, 2, [0.5, 0.5])]) == []  # a negative positive score
    assert negatives.mine(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"), F.col("vec_id") % 100 == 0, F.col("label")).count() == 0


def test_large_components_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 5)
    monkeypatch.setattr(negatives, "GROUP", 2)
    rng = np.random.default_rng(2)
    rows = [(k, k % 2, [float(x) for x in rng.integers(-(1 << 18), 1 << 18, 6) + (1 << 17)]) for k in range(300)]
    assert check(spark, rows)


def test_tree_is_of_least_length():
    rng = np.random.default_rng(3)
    x = rng.integers(-20, 20, (40, 3))
    order, parent, edge = negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and (parent[1:] < np.arange(1, 40)).all()
    assert np.allclose(edge[1:], np.linalg.norm(x[order[1:]] - x[order[parent[1:]]], axis=1))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    group, total = list(range(40)), 0.0  # Kruskal
    for a, b in sorted(((a, b) for a in range(40) for b in range(a)), key=lambda p: d[p]):
        if group[a] != group[b]:
            total += d[a, b]
            group = [group[a] if g == group[b] else g for g in group]
    assert np.isclose(total, edge.sum())


def test_bounds_spare_most_scores():
    """Where anchors lie close, candidates far from their windows are not rescored."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16)) * 300
    x = (middle[rng.integers(12, size=3000)] + rng.normal(size=(3000, 16)) * 6).astype(np.int64)
    anchors = (middle[np.repeat(np.arange(12), 10)] + rng.normal(size=(120, 16)) * 6).astype(np.int64)
    order, up, edge = negatives.spanning_tree(anchors)
    window = lambda v: [(int(0.95 * v @ v), int(2 * v @ v))]
    rows = [dict(place=k, parent=int(up[k]), edge=float(edge[k]), anchor_no=k, vec_id=-1 - k, label=5, x=anchors[i].tolist(), windows=window(anchors[i]), kind="negatives") for k, i in enumerate(order)]
    block = negatives._Block(rows, best=10)
    block.search(np.arange(3000), np.zeros(3000, np.int64), x)
    assert block.rescored < 0.35 * block.seen
    for k, i in enumerate(order):
        s = x @ anchors[i]
        inside = [(-a, j) for j, a in enumerate(s.tolist()) if window(anchors[i])[0][0] <= a <= window(anchors[i])[0][1]]
        assert [(-a, j) for a, j in block.found[k][0].tolist()] == sorted(inside)[:10]
