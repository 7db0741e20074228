import random

import numpy as np

from tidemark.llm import quality_gam as gam

DOCS, LABELS = "doc_id long, text string, score int", "doc_id long, quality int"


def corpus(n, seed):
    rnd = random.Random(seed)
    words = ["the", "river", "ran", "and", "under", "a", "bridge", "of", "stone", "while", "people", "walked", "home"]
    docs, labels = [], []
    for i in range(n):
        good = rnd.random() < 0.6
        body = [rnd.choice(words) for _ in range(rnd.randrange(20, 120))]
        text = " ".join(body).capitalize() + "." if good else rnd.choice([" ".join(w.upper() + "!!" for w in body), " | ".join(body), "spam " * len(body)])
        docs.append((i, text, 1))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(600, 1)
    model = gam.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:400], LABELS))
    rows = {r.doc_id: r for r in gam.score(spark.createDataFrame(docs, DOCS), model).collect()}
    held = labels[400:]
    assert np.mean([rows[i].predicted == y for i, y in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows.values())
    kept = gam.keep_good(spark.createDataFrame(docs, DOCS), model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.predicted}


def test_bounded_sample(spark):
    docs, labels = corpus(200, 2)
    frame = spark.createDataFrame(docs, DOCS)
    a = gam.train(frame, spark.createDataFrame(labels, LABELS), max_rows=50)
    b = gam.train(frame.repartition(3), spark.createDataFrame(labels[::-1], LABELS), max_rows=50)
    x = gam.matrix([d[1].encode() for d in docs])
    assert np.allclose(a.score(x), b.score(x))


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y, rounds=20)
    assert (0, 1) in [p[:2] for p in model.pairs]
    assert np.mean((model.score(x) >= 0.5) == y) > 0.9


def test_nulls_empty_and_no_labels(spark):
    docs = [(1, None, 0), (1, "", 0), (None, "words here", 0), (2, "x" * 300_000, 0)]
    frame = spark.createDataFrame(docs, DOCS)
    model = gam.train(frame, spark.createDataFrame([], LABELS))
    assert [r.score for r in gam.score(frame, model).collect()] == [0.5] * 4
    assert gam.keep_good(frame, model).count() == 4
    good, labels = corpus(80, 3)
    model = gam.train(spark.createDataFrame(good, DOCS), spark.createDataFrame(labels + [(None, 1), (3, None)], LABELS))
    rows = gam.score(frame, model).collect()
    assert len(rows) == 4 and rows[0].score == rows[1].score
    assert gam.score(frame.limit(0), model).count() == 0


def test_scores_against_plain_loops(spark):
    docs, labels = corpus(300, 4)
    model = gam.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert model.pairs
    odd = [(1000, None, 1), (1001, "", 1), (1002, "ünïcode — 文章 \x00 " * 40, 1), (1003, "a" * 100_000, 1)]
    for r in gam.score(spark.createDataFrame(docs + odd, DOCS), model).collect():
        text = dict(d[:2] for d in docs + odd)[r.doc_id]
        want = gam.brute_force(text, model)
        assert abs(r.score - want) < 1e-12 and r.predicted == (want >= 0.5)


def test_boosting_against_a_plain_loop():
    """The first rounds of cyclic boosting, each tree by trying every cut."""
    import math

    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (200, 2)).astype(float)
    y = (rng.random(200) < np.where(x[:, 0] > 1, 0.8, 0.3)).astype(float)
    model = gam.fit(x, y, rounds=2, pair_rounds=0, n_pairs=1)
    total = [math.log((y.sum() + 0.5) / (len(y) + 1) / (1 - (y.sum() + 0.5) / (len(y) + 1)))] * len(y)
    bins = [[sum(e <= v for e in model.edges[j]) for v in x[:, j]] for j in range(2)]

    def tree(rows, g, h, j, lo, hi, depth):
        """{bin: value} of the bins lo..hi-1."""
        of = lambda a, b: ([sum(v[i] for i in rows if a <= bins[j][i] < b) for v in (g, h)])
        gain = lambda s: s[0] ** 2 / (s[1] + 1)
        cuts = [(gain(of(lo, c)) + gain(of(c, hi)) - gain(of(lo, hi)), -c) for c in range(lo + 1, hi) if of(lo, c)[1] >= 0.5 and of(c, hi)[1] >= 0.5]
        if depth and cuts and max(cuts)[0] > 0:
            c = -max(cuts)[1]
            return tree(rows, g, h, j, lo, c, depth - 1) | tree(rows, g, h, j, c, hi, depth - 1)
        s = of(lo, hi)
        return {b: s[0] / (s[1] + 1) for b in range(lo, hi)}

    tables = [[0.0] * len(t) for t in model.tables]
    for _ in range(2):
        for j in range(2):
            p = [1 / (1 + math.exp(-t)) for t in total]
            found = tree(range(len(y)), [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p], j, 0, len(tables[j]), 2)
            for b, v in found.items():
                tables[j][b] += 0.1 * v
            total = [t + 0.1 * found[b] for t, b in zip(total, bins[j])]
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables))


def test_repeated_ids_do_not_widen_the_sample(spark):
    docs, labels = corpus(100, 6)
    one = gam.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    many = gam.train(spark.createDataFrame(docs * 20, DOCS), spark.createDataFrame(labels * 3, LABELS))
    x = gam.matrix([d[1].encode() for d in docs])
    assert np.allclose(one.score(x), many.score(x))
